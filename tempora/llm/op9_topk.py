"""Exact top-k search by inner product with two cover trees.

Candidates are dealt to cells around pivots. A query goes to the cells whose centre and radius leave room for a score
above its k-th best in a small sample, so cells that cannot help are dropped before anything is copied. In a group of
queries and candidates of bounded size both sides get a cover tree (base 2: children lie further apart than half their
parent's radius and cover its points within it; the first keeps the parent's centre), and pairs of nodes are visited
from the most promising on. A pair goes if even <q, p> + |q| R + |p| r + r R, with the centres q and p and the covering
radii r and R, is below the worst k-th score in the query node. Pairs of points are first scored on the coordinates
with most weight; where these and the norms of the rest (Cauchy-Schwarz) stay below that score, the rest is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Rows of a group of queries and of a cell's group of candidates, about; points in a leaf that is not split further.
QUERIES, CANDIDATES, LEAF = 16384, 16384, 16
#: Cells at most; vectors and bytes of the sample that gives each query a first bound, at most.
CELLS, SAMPLE, SAMPLE_BYTES = 256, 2048, 8 << 20
#: Share of the coordinates that pairs are scored on first.
FIRST = 0.75
#: Slack of bounds, relative to the norms: larger than the rounding of any sum of products here.
SLACK = 1e-9


class Node:
    """Points within ``radius`` of ``center``; a leaf has no children."""

    __slots__ = ("center", "children", "norm", "points", "radius")

    def __init__(self, x: np.ndarray, points: np.ndarray, distance: np.ndarray, center: int):
        self.center, self.points, self.children = x[center], points, []
        self.norm = float(np.sqrt(self.center @ self.center)) * (1 + SLACK)
        self.radius = float(distance.max(initial=0)) * (1 + SLACK) + self.norm * SLACK


def cover(x: np.ndarray, points: np.ndarray, distance: np.ndarray, center: int, batch: int = 256) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(points, distances, centre) of the children: centres further apart than half the radius, the parent's own first."""
    half = distance.max() / 2
    near = distance <= half
    parts, rest = [(points[near], distance[near], center)], points[~near]
    square = np.einsum("ij,ij->i", x[rest], x[rest])
    while len(rest):
        some = rest[:batch]
        d = np.sqrt(np.maximum(0, square[:, None] + square[None, : len(some)] - 2 * (x[rest] @ x[some].T)))
        free = np.ones(len(rest), bool)
        for j, at in enumerate(some.tolist()):
            if free[j]:
                take = free & (d[:, j] <= half)
                take[j] = True
                own = d[take, j]
                own[0] = 0  # rounding: the centre comes first among those still free
                parts.append((rest[take], own, at))
                free &= ~take
        rest, square = rest[free], square[free]
    return parts


def tree(x: np.ndarray) -> Node:
    """The cover tree of some rows. Children of one point stay together in a leaf with their parent's ball, which bounds them as well."""
    y = x - x[0]
    d = np.sqrt(np.einsum("ij,ij->i", y, y))
    root = Node(x, np.arange(len(x)), d, 0)
    work = [(root, d, 0)]
    while work:
        node, d, at = work.pop()
        if len(node.points) <= LEAF or d.max() == 0:
            continue
        alone = []
        for points, own, center in cover(x, node.points, d, at):
            if len(points) == 1:
                alone.append(points)
            else:
                child = Node(x, points, own, center)
                node.children.append(child)
                work.append((child, own, center))
        if alone:
            node.children.append(Node(x, np.concatenate(alone), d, at))
    return root


class Best:
    """The k best candidates of each query so far, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def found(self) -> Iterator[tuple[int, int, int]]:
        for at, place in zip(*np.nonzero(self.score > -np.inf), strict=True):
            yield int(at), int(self.id[at, place]), int(self.score[at, place])

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """rows: queries; scores: of each of them with each id; -inf where it is no candidate."""
        worst = self.score[rows, -1]
        if scores.shape[1] > self.k:
            worst = np.maximum(worst, np.partition(scores, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((scores >= worst[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        who = np.unique(r)
        row = np.concatenate([rows[r], np.repeat(rows[who], self.k)])
        score = np.concatenate([scores[r, c], self.score[rows[who]].ravel()])
        name = np.concatenate([ids[c], self.id[rows[who]].ravel()])
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[row[keep], place[keep]] = score[keep]
        self.id[row[keep], place[keep]] = name[keep]


def _double(n: int | float) -> float:
    try:
        return float(n)
    except OverflowError:
        return float("inf") if n > 0 else float("-inf")


class LargeBest:
    """The same for values whose sums leave the whole numbers of doubles: what passes the bound is scored in whole numbers of any size."""

    def __init__(self, q: np.ndarray, c: np.ndarray, unit: float, k: int):
        self.k, self.q, self.c, self.unit = k, q, c, unit
        self.worst, self.best = np.full(len(q), -np.inf), [[] for _ in range(len(q))]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, columns: np.ndarray) -> None:
        for i, row in enumerate(rows.tolist()):
            mine = [int(v) for v in self.q[row].tolist()]
            open_ = np.flatnonzero((scores[i] >= self.worst[row]) & (scores[i] > -np.inf))
            more = [(-sum(a * int(b) for a, b in zip(mine, self.c[columns[j]].tolist(), strict=True)), int(ids[j])) for j in open_.tolist()]
            self.best[row] = sorted(self.best[row] + more)[: self.k]
            if len(self.best[row]) == self.k:
                self.worst[row] = -_double(self.best[row][-1][0] / int(self.unit)) if self.unit < 1e300 else -np.inf

    def found(self) -> Iterator[tuple[int, int, int]]:
        for row, best in enumerate(self.best):
            for s, name in best:
                yield row, name, -s


def dual_search(q: np.ndarray, q_key: np.ndarray, c: np.ndarray, c_id: np.ndarray, c_key: np.ndarray, k: int) -> tuple[Best | LargeBest, int]:
    """The k best of each query, and how many pairs were scored in full. A candidate with the query's key is the query itself."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if q.shape[1] * top < 2.0**52:
        best, x, y = Best(len(q), k), q, c
    else:
        a, b = (2.0 ** np.floor(np.log2(max(1.0, float(np.abs(z).max(initial=0))))) for z in (q, c))
        best, x, y = LargeBest(q, c, a * b, k), q / a, c / b
    # coordinates with most weight first; the norms of the others
    order = np.argsort(-np.einsum("ij,ij->j", y, y), kind="stable")
    x, y = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(y[:, order])
    m = -(-int(x.shape[1] * FIRST * 100) // 100)
    x_norm, y_norm = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y))
    x_rest, y_rest = (np.sqrt(np.einsum("ij,ij->i", z[:, m:], z[:, m:])) * (1 + SLACK) for z in (x, y))
    scored = 0

    def score(rows: np.ndarray, columns: np.ndarray) -> None:
        nonlocal scored
        step, j = 64, 0  # few at first, which give the bound for the others
        while j < len(columns):
            col = columns[j : j + step]
            j, step = j + step, min(2048, 2 * step)
            for i in range(0, len(rows), 512):
                row = rows[i : i + 512]
                slack = SLACK * np.outer(x_norm[row], y_norm[col])
                part = x[row, :m] @ y[col, :m].T
                open_ = ~(part + np.outer(x_rest[row], y_rest[col]) + slack < best.worst[row][:, None])
                open_ &= q_key[row][:, None] != c_key[col][None, :]
                n = int(open_.sum())
                scored += n
                if n * 4 > open_.size:
                    part += x[row, m:] @ y[col, m:].T
                    part[~open_] = -np.inf
                elif n:
                    r, s = np.nonzero(open_)
                    value = part[r, s] + np.einsum("ij,ij->i", x[row[r], m:], y[col[s], m:])
                    part = np.full_like(part, -np.inf)
                    part[r, s] = value
                if n and isinstance(best, LargeBest):
                    best.add(row, c_id[col], part + slack, col)
                elif n:
                    best.add(row, c_id[col], part)

    stack = [(np.inf, tree(x), tree(y))]
    while stack:
        bound, a, b = stack.pop()
        if bound < best.worst[a.points].min():
            continue
        if not a.children and not b.children:
            score(a.points, b.points)
            continue
        left, right = a.children or [a], b.children or [b]
        dot = np.stack([n.center for n in left]) @ np.stack([n.center for n in right]).T
        r, s = np.array([n.radius for n in left])[:, None], np.array([n.radius for n in right])[None, :]
        u, v = np.array([n.norm for n in left])[:, None], np.array([n.norm for n in right])[None, :]
        bounds = dot + u * s + v * r + r * s + SLACK * u * v
        # the best bound is popped first
        stack.extend((float(bounds.flat[z]), left[z // len(right)], right[z % len(right)]) for z in np.argsort(bounds, axis=None))
    return best, scored


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-number vectors of rows whose components are all finite."""
    for batch in batches:
        ids, out = [], []
        lists = batch.column(1)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        x = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(float), nan=np.nan, posinf=np.inf, neginf=-np.inf)
        edge = np.concatenate([[0], np.cumsum(n)])
        x = np.floor(256 * x)
        wrong = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(x))])
        good = (wrong[edge[1:]] == wrong[edge[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for i, v in zip(np.flatnonzero(good), batch.column(0).filter(pa.array(good)).to_pylist(), strict=True):
            ids.append(v)
            out.append(x[edge[i] : edge[i + 1]].tobytes())
        yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "v": pa.array(out, pa.binary()), "wanted": batch.column(2).filter(pa.array(good))})


def _by_size(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of vector: their places and the vectors."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(values[i] for i in at), float).reshape(len(at), -1)


class Cells:
    """Pivots of each length of vector (a bounded sample), later with the radius and the number of rows of each cell."""

    def __init__(self, pivots: list[bytes]):
        self.pivots, self.first, n = {}, {}, 0
        for at, x in _by_size(pivots):
            self.pivots[x.shape[1] * 8], self.first[x.shape[1] * 8] = x, n
            n += len(at)
        self.radius, self.parts = np.full(n, np.inf), np.ones(n, np.int64)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance from its pivot; -1 for vectors of a length without pivots."""
        p = self.pivots.get(x.shape[1] * 8)
        if p is None:
            return np.full(len(x), -1), np.zeros(len(x))
        at = np.argmin(np.einsum("ij,ij->i", p, p)[None, :] - 2 * (x @ p.T), axis=1)
        y = x - p[at]
        return at + self.first[x.shape[1] * 8], np.sqrt(np.einsum("ij,ij->i", y, y))


def _placed(cells: Cells) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for at, x in _by_size(batch.column(1).to_pylist()):
                cell[at], far[at] = cells.place(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _routed(cells: Cells, sample: list[bytes], keys: list[int], k: int) -> Callable:
    """The cells that may hold one of a query's k best."""
    known = {x.shape[1]: (x, np.array(keys, np.int64)[at]) for at, x in _by_size(sample)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes: list[list[int]] = [[] for _ in range(len(batch))]
            key = batch.column(2).to_numpy()
            for at, x in _by_size(batch.column(1).to_pylist()):
                p = cells.pivots.get(x.shape[1] * 8)
                if p is None:
                    for i in at.tolist():
                        routes[i] = [-1]
                    continue
                first, norm = cells.first[x.shape[1] * 8], np.sqrt(np.einsum("ij,ij->i", x, x))
                worst = np.full(len(x), -np.inf)
                if x.shape[1] in known:
                    y, name = known[x.shape[1]]
                    s = x @ y.T - SLACK * np.outer(norm, np.sqrt(np.einsum("ij,ij->i", y, y)))
                    s[key[at][:, None] == name[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        worst = np.partition(s, -k, axis=1)[:, -k]
                radius = cells.radius[first : first + len(p)]
                most = x @ p.T + norm[:, None] * radius * (1 + SLACK) + SLACK * np.outer(norm, np.sqrt(np.einsum("ij,ij->i", p, p)))
                for i, keep in zip(at.tolist(), ~(most < worst[:, None]), strict=True):
                    routes[i] = (np.flatnonzero(keep) + first).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def _searched(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            q = np.frombuffer(b"".join(queries.v), float).reshape(len(queries), -1)
            c = np.frombuffer(b"".join(rows.v), float).reshape(len(rows), -1)
            q_id, key = queries.vec_id.to_numpy(), queries["key"].to_numpy()
            # only the first of equal rows is a query itself; the others are its candidates
            c_key = np.where(rows["copy"].to_numpy() == 0, rows["key"].to_numpy(), 0)
            best, _ = dual_search(q, np.where(key == 0, 1, key), c, rows.vec_id.to_numpy(), c_key, k)
            out = [(int(q_id[i]), int(key[i]), name, score) for i, name, score in best.found()]
        # ``about`` has the order of scores beyond 64 bits too
        about = [_double(s) for *_, s in out]
        scores = [s if -(1 << 63) <= s < 1 << 63 else None for *_, s in out]
        return pd.DataFrame({
            "query_id": np.array([r[0] for r in out], np.int64), "key": np.array([r[1] for r in out], np.int64), "vec_id": np.array([r[2] for r in out], np.int64),
            "score": pd.Series(scores, dtype="Int64"), "about": np.array(about, float),
        })

    return run


def top_k(vectors: DataFrame, query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(256 * x) for each row that satisfies ``query``.

    Every row but the query's own is a candidate, rows that share its id or repeat it too. Ties go to the smaller id;
    fewer candidates give fewer rows. A row that repeats a query is a query of its own with rows of its own. Vectors
    that are null or hold null or non-finite components (before or after the scaling), and rows without an id, take no
    part; vectors meet those of the same length only. Values of any size are compared as whole numbers; a score beyond
    64 bits is null, at its rank. Other columns are not read.
    """
    wanted = F.coalesce(query, F.lit(False)).cast("int").alias("wanted")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), wanted)
    rows = rows.mapInArrow(_valid, "vec_id long, v binary, wanted int").groupBy("vec_id", "v").agg(F.count("*").alias("times"), F.sum("wanted").alias("asked"))
    rows = checkpointed(rows.select("vec_id", "v", F.xxhash64("vec_id", "v").alias("key"), "times", "asked"))
    n, m, size = rows.agg(F.count("*"), F.count_if(F.col("asked") > 0), F.max(F.octet_length("v"))).first()
    chosen = lambda seed, most: rows.orderBy(F.xxhash64("key", F.lit(seed)), "vec_id").limit(most).select("key", "v").collect()
    cells = Cells([bytes(r["v"]) for r in chosen(21, min(CELLS, -(-n // CANDIDATES)))])
    held = rows.mapInArrow(_placed(cells), "vec_id long, v binary, key long, times long, asked long, cell int, far double")
    for r in held.filter("cell >= 0").groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        cells.radius[r["cell"]], cells.parts[r["cell"]] = r["far"], -(-r["n"] // CANDIDATES)
    sample = chosen(22, max(1, min(SAMPLE, SAMPLE_BYTES // max(1, size or 1))))
    part_of = {int(c): int(p) for c, p in enumerate(cells.parts) if p > 1}
    parts = F.coalesce(*(F.when(F.col("cell") == c, p) for c, p in part_of.items()), F.lit(1))
    routes = rows.filter("asked > 0").mapInArrow(_routed(cells, [bytes(r["v"]) for r in sample], [r["key"] for r in sample], k), "vec_id long, v binary, key long, times long, asked long, cells array<int>")
    block = lambda seed, b: F.pmod(F.xxhash64("key", F.lit(seed)), b).cast("int")
    qb = block(1, F.lit(-(-m // QUERIES) or 1))
    sent = routes.select("vec_id", "v", "key", F.octet_length("v").alias("dim"), qb.alias("qb"), F.explode("cells").alias("cell"))
    meets = sent.select("dim", "cell", "qb").distinct().groupBy("dim", "cell").agg(F.collect_list("qb").alias("qbs"))
    sent = sent.withColumn("cb", F.explode(F.sequence(F.lit(0), parts - 1)))
    # of equal rows, more than k + 1 cannot all be among the best
    copies = F.explode(F.sequence(F.lit(0), F.least(F.col("times"), F.lit(k + 1)).cast("int") - 1)).alias("copy")
    given = held.select("vec_id", "v", "key", F.octet_length("v").alias("dim"), "cell", block(2, parts).alias("cb"), copies)
    given = given.join(meets, ["dim", "cell"]).withColumn("qb", F.explode("qbs")).drop("qbs")
    keys = ("dim", "cell", "cb", "qb")
    found = sent.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(_searched(k), "query_id long, key long, vec_id long, score long, about double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("about"), F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    again = rows.filter("asked > 1").select(F.col("vec_id").alias("query_id"), "key", "asked")
    out = ranked.join(again, ["query_id", "key"], "left").withColumn("_", F.explode(F.sequence(F.lit(1), F.coalesce("asked", F.lit(1)).cast("int"))))
    return out.select("query_id", "rank", "vec_id", "score")


def op9_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.e) = len(q.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
