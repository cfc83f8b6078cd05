"""Stages of the pipeline decide by row: rows without an id and rows that share one are documents of their own."""

from __future__ import annotations

import numpy as np

import corpus_pipeline

local = np.random.default_rng(8)
WORDS = [f"{a}{b}" for a in ("ri", "sto", "gre", "wal", "hou", "li") for b in ("ver", "ne", "en", "ks", "se")]
A, B, C, D = (" ".join(local.choice(WORDS, 60).tolist()) for _ in range(4))
SCHEMA = "doc_id long, text string, row string"


def kept(spark, stage, rows, folder=""):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in stage(spark, spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), folder).collect())


def plain(rows):
    return sorted((i is None, i or 0, t or "") for i, t in rows)


def test_near_dedup_by_row(spark):
    near = [(None, A + " more"), (5, A + " again"), (6, A + " anew"), (None, D + " more")]
    clean = [(1, A), (None, B), (5, C), (6, ""), (None, None), (9, D)]
    again = [(None, B), (6, ""), (None, None)]  # these repeat an id and text
    assert kept(spark, corpus_pipeline.near_dedup_stage, near + clean + again) == plain(clean)


def test_decontamination_by_row(spark, tmp_path):
    item = local.choice(WORDS, 40).tolist()
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaks = [(None, A + " " + " ".join(item)), (3, " ".join(item) + " " + B), (4, " ".join(item))]
    clean = [(None, A), (None, None), (3, C), (8, " ".join(item[:22])), (8, " ".join(item[18:])), (None, D)]
    assert kept(spark, corpus_pipeline.decontamination_stage, leaks + clean, str(tmp_path)) == plain(clean)


HARD = "doc_id long, text string, row string, score string, spans string, clean string, doc string, _0 string, label int, part double"
SECRET = "first token=abcdef12 AKIA" + "B" * 16 + "; password: token=secretsecret 0123456789abcdef0123456789abcdef end"
ROWS = [(None, "a text without an id"), (None, None), (None, None), (1, ""), (1, ""), (1, "another text of one"), (2, " ".join(local.choice(WORDS, 60_000).tolist())), (3, SECRET), (3, SECRET), (2**63 - 1, "ü \U0001f600 last")]


def hard(spark, rows):
    return spark.createDataFrame([(i, t, "r", "s", "p", "c", "d", "0", 7, 0.5) for i, t in rows], HARD).repartition(3)


def test_every_stage_on_hard_rows(spark, tmp_path):
    """Null, shared and repeated ids, empty and very long texts, clashing columns, empty tables beside them; clean rows stay."""
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, counted = hard(spark, ROWS), lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    at = corpus_pipeline.toxicity_stage(spark, docs, folder)
    assert at.columns == docs.columns and counted(at) == plain(ROWS)
    at = corpus_pipeline.near_dedup_stage(spark, docs, folder)
    assert at.columns == docs.columns and counted(at) == plain(list(dict.fromkeys(ROWS)))  # rows that repeat id and text are one
    at = corpus_pipeline.decontamination_stage(spark, docs, folder)
    assert at.columns == docs.columns and counted(at) == plain(ROWS)
    at = corpus_pipeline.secrets_stage(spark, docs, folder)
    clean = "first [secret] [secret]; [secret] [secret] end"
    assert at.columns == docs.columns and counted(at) == plain([(i, clean if t == SECRET else t) for i, t in ROWS])
    pieces = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.doc_tokens): sum(q.length for q in pieces if (q.doc_id, q.doc_tokens) == (p.doc_id, p.doc_tokens)) for p in pieces}.values())
    assert len([p for p in pieces if p.doc_id is None and p.start == 0]) == 3 and len([p for p in pieces if p.doc_id == 3 and p.start == 0]) == 2
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
