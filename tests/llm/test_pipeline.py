"""The stages on a small folder: each decision takes effect, clean documents stay, and columns go along."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm.common import checkpointed


def test_stages(spark, tmp_path):
    local = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ri", "sto", "gre", "wal", "hou", "li") for b in ("ver", "ne", "en", "ks", "se")]
    texts = {i: " ".join(local.choice(words, 60).tolist()) for i in range(400)}
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    for i in range(0, 400, 4):
        texts[i] = " ".join([*texts[i].split(" ")[:56], "you", "vilexo", "awfulx", "vilexo"])
    texts[1001] = texts[1]  # an exact and a near copy
    texts[1002] = texts[2] + " more"
    item = " ".join(local.choice(words, 30).tolist())
    texts[1003] = " ".join(local.choice(words, 30).tolist()) + " " + item
    texts[1004] = " ".join(local.choice(words, 30).tolist()) + " \U0001f600 password=hunter22x and token: abcdefgh end"
    texts[1005] = None
    rows = [(i, t, "en", "s", len(t or ""), "k", "x") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = checkpointed(stage(spark, at, str(tmp_path)))
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "packing":
            assert at.columns == docs.columns
    clean = {i for i in range(400) if i % 4}
    assert clean | {1001, 1002, 1003, 1004, 1005} == set(seen["toxicity"])
    assert set(seen["near_dedup"]) == set(seen["toxicity"]) - {1001, 1002}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {1003}
    assert set(seen["secrets"]) == set(seen["decontamination"]) == set(seen["packing"])
    assert seen["secrets"][1004].text.endswith(" \U0001f600 [secret] and [secret] end") and seen["secrets"][1004].kept == "k"
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] > 0
