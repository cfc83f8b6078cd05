"""The labelled sample has every text once, whatever it opens with, and is the same at every run."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_sample_of_texts_that_open_alike(spark):
    from tempora.llm.sampling import labelled_sample

    header = "a header that all the pages of one source have in common " * 2
    texts = [(i, header + f"page {i % 30}") for i in range(60)] + [(60, None), (61, ""), (62, header + "page 0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 62)) for i, _ in texts], "doc_id long, toxic int")
    first: dict = {}
    for i, t in texts:
        first.setdefault((t, int(i == 62)), i)
    for parts in (1, 7):
        got = labelled_sample(docs.repartition(parts, "doc_id"), labels, "toxic", F.lit(True), 1000).collect()
        assert sorted(r.doc_id for r in got) == sorted(first.values())
        assert {(r.text, r.label): r.doc_id for r in got} == first


def test_bounds_of_samples(spark):
    from tempora.llm.sampling import FINE, labelled_sample, share_of

    # a table of any size has a sample
    assert share_of(2400, 10**15) == 3 and share_of(10, 10) == FINE and 2000 < share_of(2400, 10**10) * 10**10 / FINE < 2800
    texts = [(i, f"{i} " + "x" * (i % 90)) for i in range(500)] + [(1000, "y" * 400), (7, "another text of 7")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in texts], "doc_id long, quality int")
    whole = labelled_sample(docs, labels, "quality", F.lit(True), 10000, 1 << 30).count()
    assert whole == 502
    for most in (4000, 6000, 12000):
        got = [labelled_sample(docs.repartition(n), labels, "quality", F.lit(True), 10000, most).collect() for n in (2, 5)]
        assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
        size = sum(len(r.text) for r in got[0])
        assert most * 0.8 < size <= most and max(len(r.text) for r in got[0]) <= most // 16
    assert labelled_sample(docs, labels, "quality", F.lit(True), 10000, 16).count() == 0
