"""Vector codes, SimHash and resampling against brute force, on hard rows and on skewed ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import BASE, SCHEMA, TEXTS

from tempora.llm import op11_codes, op12_simhash, op13_resampling


def lower(text: str | None) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@pytest.fixture(scope="module")
def rows():
    found = [(k * 3 + 1, t) for k, t in enumerate(TEXTS)]
    return found + [(16, BASE), (None, BASE), (None, "null id"), (None, "null id"), (None, None), (4, "shares an id"), (2**63 - 1, "the largest id of all of them here"), (-5, "x" * 5000 + " y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, None, "s", len(t or ""), "d", 1, "s", "x", "k", "h", 2) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


# SimHash


def fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(fps: list[int], ids: list) -> list:
    """The least id of each row's component, by the definition."""
    label = list(range(len(fps)))
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(fps))]
    while (new := [min(label[j] for j in near[i]) for i in range(len(fps))]) != label:
        label = new
    least = {}
    for at, i in zip(label, ids, strict=True):
        if i is not None:
            least[at] = min(i, least.get(at, i))
    return [least.get(at) for at in label]


def test_simhash_on_hard_rows(docs, rows, nothing):
    fps = [fingerprint(t) for _, t in rows]
    expected = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, least_reachable(fps, [i for i, _ in rows]), strict=True)), key=str)
    assert collected(op12_simhash.near_fingerprints(docs)) == expected
    assert op12_simhash.near_fingerprints(nothing).count() == 0


def clusters(n: int, seed: int) -> list[int]:
    """Fingerprints in chains and balls: one ball holds most, some bits hardly vary, zero and its neighbours are there."""
    rng = np.random.default_rng(seed)
    biased = rng.random(64) < 0.3
    out = [0, 7, 8, 15, 1 << 63, (1 << 64) - 1]
    for k in range(12):
        bits = np.where(biased, rng.random(64) < 0.02, rng.random(64) < 0.5)
        center = int(sum(1 << int(b) for b in np.flatnonzero(bits)))
        for _ in range(n if k == 0 else n // 20):
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False).tolist():
                center ^= (1 << b) * int(rng.random() < 0.5)
            flips = rng.choice(64, int(rng.integers(0, 9)), replace=False)
            out.append(center ^ sum(1 << int(b) for b in flips))
    return sorted(set(out))


@pytest.mark.parametrize(("block", "probe"), [(2048, 200), (8, 200), (64, 1)])
def test_no_link_is_lost(spark, monkeypatch, block, probe):
    """Large values are refined and cut into blocks; probes beyond a group's own value are made if they are cheap."""
    monkeypatch.setattr(op12_simhash, "BLOCK", block)
    fps = clusters(300, block + probe)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    links = {(r["a"], r["b"]) for r in op12_simhash.hamming_links(nodes).collect()}
    top = {f: f for f in signed}

    def root(f: int) -> int:
        while top[f] != f:
            f = top[f]
        return f

    for a, b in links:
        top[max(root(a), root(b))] = min(root(a), root(b))
    found = Counter(Counter(root(f) for f in signed).values())
    assert found == Counter(Counter(least_reachable(fps, list(range(len(fps))))).values())
    assert len(links) < 40 * len(fps)


def test_thresholds_add_up():
    fps = np.array(clusters(400, 3), np.uint64)
    plan = op12_simhash.Plan(fps, 10**7)  # a large table, so unequal thresholds pay
    value = plan.values(fps)
    chosen = plan.thresholds(value)
    assert (chosen.sum(axis=1) == op12_simhash.MOST - op12_simhash.GROUPS + 1).all() and (chosen >= -1).all()
    assert len(np.unique(chosen, axis=0)) > 2
    price = [[0, *(plan.near[g, t][value[:, g]] + op12_simhash.PROBE * sum(math.comb(16, k) for k in range(t + 1)) for t in range(4))] for g in range(4)]
    cost = lambda c: sum(np.choose(c[:, g] + 1, [np.zeros(len(fps)) + p for p in price[g]]) for g in range(4))
    assert (cost(chosen) <= cost(np.zeros_like(chosen)) + 1e-6).all()
    for other in ([1, -1, 0, 0], [-1, 1, 0, 0], [0, 0, 1, -1], [3, -1, -1, -1], [1, 1, -1, -1]):
        assert (cost(chosen) <= cost(np.tile(other, (len(fps), 1))) + 1e-6).all()
    # estimates by counting
    apart = np.bitwise_count(value[:, None, 0] ^ value[None, :, 0])
    counted = (apart <= 1).sum(axis=1) * 10**7 / (len(fps) + 1)
    assert np.allclose(plan.near[0, 1][value[:, 0]], counted, atol=10**7 / (len(fps) + 1) * 0.01)


# vector codes


def codes(rows: list[tuple]) -> list[tuple]:
    """vec_id, code, error, label_error, digest by the definition, in whole numbers."""
    valid = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    valid.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not valid:
        return []
    d = len(valid[0][1])
    valid = [(i, [op11_codes.whole(x) for x in v], c) for i, v, c in valid if len(v) == d]
    cut = [k * d // 8 for k in range(9)]
    book = [[v[cut[p] : cut[p + 1]] for _, v, _ in valid[:16]] for p in range(8)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    best = lambda v, p: min((apart(v[cut[p] : cut[p + 1]], e), j) for j, e in enumerate(book[p]))
    for _ in range(6):
        held = [[best(v, p)[1] for p in range(8)] for _, v, _ in valid]
        for p in range(8):
            for j in range(len(book[p])):
                mine = [v[cut[p] : cut[p + 1]] for (_, v, _), h in zip(valid, held, strict=True) if h[p] == j]
                if mine:
                    book[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    final = [[best(v, p) for p in range(8)] for _, v, _ in valid]
    error = [min(sum(s for s, _ in f), 2**63 - 1) for f in final]
    total = Counter()
    for (_, _, c), e in zip(valid, error, strict=True):
        total[c] += e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, min(total[c], 2**63 - 1), told) for (i, _, c), f, e in zip(valid, final, error, strict=True)]


def coded(spark, tmp_path, rows: list[tuple]) -> list[tuple]:
    schema = "vec_id long, embedding array<double>, label int, state string, code int, v int, cell int, wide int"
    df = spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in rows], schema).repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return collected(op11_codes.op11_vector_codes(spark, str(tmp_path)))


def vectors(n: int, d: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(5, d))
    return [(int(k) * 3, (center[k % 5] + 0.2 * rng.normal(size=d)).tolist(), None if k % 7 == 0 else int(k % 3 == 0)) for k in rng.permutation(n)]


def test_codes_on_hard_rows(spark, tmp_path):
    rows = vectors(120, 20, 5)  # eight parts of two or three components
    some = rows[0][1]
    rows += [(None, some, 1), (None, None, 2), (7, None, None), (8, [None, *some[1:]], 1), (9, [math.nan, *some[1:]], 1), (10, [math.inf, *some[1:]], 1), (11, [], 1), (13, some[:-1], 1)]
    rows += [rows[3]] * 3 + [(rows[4][0], some, 9), (0, some, None), (1, [x * 100 for x in some], 3)]
    assert coded(spark, tmp_path, rows) == sorted(codes(rows), key=str)


def test_codes_of_huge_and_few_vectors(spark, tmp_path):
    rows = vectors(40, 9, 6)
    rows += [(1000 + k, [x * 10.0**e for x in rows[k][1]], 5) for k, e in enumerate((3, 6, 9, 15, 30, 305))]
    assert coded(spark, tmp_path / "a", rows) == sorted(codes(rows), key=str)
    few = vectors(5, 3, 7)  # fewer than eight components, fewer than 16 vectors
    assert coded(spark, tmp_path / "b", few) == sorted(codes(few), key=str)
    assert coded(spark, tmp_path / "c", [(1, None, 1)]) == []


def test_bounds_spare_comparisons_and_are_no_looser_than_sums_of_moves():
    rng = np.random.default_rng(8)
    x = np.floor(4096 * (rng.normal(size=(8, 16))[rng.integers(0, 8, 4000)] + 0.05 * rng.normal(size=(4000, 16))))
    edge, state = op11_codes.cuts(16), np.zeros((4000, 8), op11_codes.STATE)
    history = [[[[int(v) for v in row[edge[p] : edge[p + 1]]] for row in x[:16]] for p in range(8)]]
    compared = []
    for r in range(7):
        state = op11_codes.reassigned(state, x, history, op11_codes.moves(history), edge)
        compared.append((state["stamp"] == r).mean())
        exact = np.stack([op11_codes.squares(x[:, edge[p] : edge[p + 1]], history[-1][p]).argmin(axis=1) for p in range(8)], axis=1)
        assert (state["entry"] == exact).all()
        history.append([[[int(v) for v in np.floor(x[exact[:, p] == j, edge[p] : edge[p + 1]].mean(axis=0))] if (exact[:, p] == j).any() else history[-1][p][j] for j in range(16)] for p in range(8)])
    assert compared[0] == 1 and compared[-1] < 0.5
    own = op11_codes.moves(history)[0]
    summed = sum(op11_codes.moves(history[k : k + 2])[0][0] for k in range(len(history) - 1))
    assert (own[0] <= summed * (1 + 1e-9)).all() and (own[0] < summed * 0.99).any()


# resampling


def resampled(rows: list[tuple], target: list[str], percent: int = 25, least: int = 20) -> list[tuple]:
    def parts(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return w, [zlib.crc32(f) % 10000 for f in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]]

    mine, theirs = [parts(t) for _, t in rows], [parts(t)[1] for t in target]
    s, t = Counter(b for _, f in mine for b in f), Counter(b for f in theirs for b in f)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for (i, _), (w, f) in zip(rows, mine, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("percent", "least"), [(25, 20), (60, 1), (100, 0), (0, 0), (50, 10**9)])
def test_resampling_on_hard_rows(spark, docs, rows, nothing, percent, least):
    target = ["Alpha the x of the x run", None, "", "loop  far-NEAR 1"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    names = ("doc_id", "n_features", "weight", "score", "rank")
    assert collected(op13_resampling.resample(docs, goal, percent, least).select(*names)) == resampled(rows, target, percent, least)
    if percent == 25:
        assert op13_resampling.resample(nothing, goal).count() == 0
        assert collected(op13_resampling.resample(docs, nothing, percent, least).select(*names)) == resampled(rows, [], percent, least)


def test_resampling_with_ties(spark):
    """Many rows at one score and id: ranks are dense, and equal rows share what is left."""
    rows = [(5, "same words here")] * 40 + [(5, "same words here too")] * 3 + [(k, "other text of words") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([("other",)], "text string")
    found = collected(op13_resampling.resample(df, goal, 90, 0).select("doc_id", "n_features", "weight", "score", "rank"))
    assert found == resampled(rows, ["other"], 90, 0)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 90 * len(rows) // 100 + 1))


def test_bisection(spark):
    rng = np.random.default_rng(1)
    values = sorted(rng.integers(-(2**62), 2**62, 200).tolist() + [5] * 30)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for want in (1, 17, 100, 115, 230):
        assert op13_resampling.bisect(df, F.col("v"), values[0], values[-1], want) == values[want - 1]
