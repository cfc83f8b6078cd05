"""What the bands of near-dedup find on a real table, against all pairs; and classifiers on hard rows."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

TABLE = "/root/testdata/sf0.1/documents.parquet"


def linked_pairs(path: str) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The different shingle sets of a table, and all pairs of them at 0.75 or more."""
    from tempora.llm.common import blocks
    from tempora.llm.op2_minhash import linked, shingle_sets

    sets = {}
    for batch in pq.ParquetFile(path).iter_batches(columns=["text"]):
        for _, data, offsets in blocks(batch, "text"):
            value, count = shingle_sets(data, offsets)
            for s in np.split(value, np.cumsum(count)[:-1]):
                if len(s):
                    sets[s.tobytes()] = s
    sets = list(sets.values())
    size = np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    pairs = []
    for k, s in enumerate(sets):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        shared = np.bincount(np.concatenate([of[a:b] for a, b in zip(lo[hi - lo > 1], hi[hi - lo > 1], strict=True)]), minlength=len(sets)) if (hi - lo > 1).any() else np.zeros(len(sets), int)
        pairs += [(k, int(j)) for j in np.flatnonzero(linked(shared, size[k], size)) if j > k]
    return sets, pairs


@pytest.mark.skipif(not Path(TABLE).exists(), reason="no test tables")
def test_recall_of_bands():
    from tempora.llm.op2_minhash import ROWS, signatures

    sets, pairs = linked_pairs(TABLE)
    sign = signatures(np.concatenate(sets), np.array([len(s) for s in sets])).reshape(len(sets), -1, ROWS)
    found = [bool((sign[a] == sign[b]).all(axis=1).any()) for a, b in pairs]
    print("pairs", len(pairs), "found", sum(found))
    assert len(pairs) > 50 and np.mean(found) > 0.99


def test_learned_operators_on_hard_rows(spark):
    """Ties, repeated rows, null ids and texts, bytes that are no UTF-8, clashing columns and empty tables."""
    from tempora.llm.op4_quality import quality
    from tempora.llm.op5_language import language
    from tempora.llm.op10_toxicity import toxicity

    rows = [(k, ("good text " if k % 2 else "BAD!!! ") * 5 + str(k // 4)) for k in range(80)] + [(None, None), (None, "x"), (5, "again"), (5, "again"), (90, ""), (91, "word " * 30_000)]
    schema = "doc_id long, text string"
    clash = {"score": F.lit("s"), "held_out": F.lit(1), "label": F.lit(2), "part": F.lit(3.0), "lang_pred": F.lit("p"), "predicted": F.lit("q"), "quality": F.lit(1), "toxic": F.lit(1)}
    docs = spark.createDataFrame(rows, schema).unionByName(spark.sql("select 92L as doc_id, cast(X'61FF62' as string) as text")).withColumns(clash)
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(80)] + [(3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality, toxicity):
        for told in (labels, labels.limit(0)):
            got = f(docs, told).collect()
            assert len(got) == 87 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
            again = {(r.doc_id, r.score) for r in got if r.doc_id == 5}
            assert len(again) <= 2 and len([r for r in got if r.doc_id == 5]) == 3  # rows that repeat id and text agree
        first, second = (sorted((r.doc_id or -1, round(r.score, 9)) for r in f(docs.repartition(n), labels).collect()) for n in (1, 5))
        assert first == second
        assert f(docs.limit(0), labels).count() == 0
    told = docs.withColumn("lang", F.when(F.col("doc_id") < 80, F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a")))
    for rows_ in (told, told.filter("doc_id is null or doc_id > 79")):  # the second has nothing to learn from
        got = language(rows_).collect()
        assert len(got) == rows_.count() and all(0 <= r.score <= 1 for r in got)
    assert language(told.limit(0)).count() == 0
