"""Product codes of vectors: k-means over each part of the vectors, in whole numbers, with norm-of-sum bounds.

Vectors are cut into parts, and every part position has a codebook. With each part's assignment a row keeps an upper bound
of the distance to its entry, a lower bound of the distance to all others, and the round in which both were exact. The
codebooks of all rounds are kept too, so a later round widens the bounds by how far the entries have moved on the whole
since that stamp (the norm of the summed moves), which is never more than the sum of the moves' norms. Only where the bounds
then overlap is the part compared with all entries again, exactly. A round is one pass: rows go to the checkpoint with
their new state, and each task adds the sums that its reassigned parts bring to the codebook, which meet by position.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import checkpointed, released, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Relative slack of the bounds, larger than any rounding of theirs.
SLACK = 1e-6
#: Rows that are decoded at a time.
ROWS = 4096
#: Whole numbers are exact in doubles up to here.
EXACT = 1 << 52
#: Sums travel in pieces of this many bits, so that they may have any size.
LIMB = 32
MOST = (1 << 63) - 1
#: State of a part: entry, round of the bounds, upper and lower bound.
STATE = np.dtype([("entry", "u1"), ("stamp", "u1"), ("upper", "<f4"), ("lower", "<f4")])

Codebook = list[list[list[int]]]  # by part, entry, position


def cuts(d: int) -> list[int]:
    """Where the parts of a vector of length ``d`` begin, and its end."""
    return [k * d // PARTS for k in range(PARTS + 1)]


def whole(x: float) -> int:
    """floor(SCALE * x) of a finite number of any size."""
    return math.floor(SCALE * x) if abs(x) < 1e300 else int(x) * SCALE


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, v, wide of the valid vectors: two or four bytes a component where they fit, else the doubles themselves (wide 8)."""
    for batch in batches:
        kept, data, width = [], [], []
        values = batch.column(1)
        for k in range(len(batch)):
            x = values[k].values
            if x is None or x.null_count:
                continue
            x = x.to_numpy(zero_copy_only=False)
            if not np.isfinite(x).all():
                continue
            most = np.abs(x).max(initial=0)
            if most < 1 << 16:
                n = np.floor(SCALE * x)
                fits = most < (1 << 15) / SCALE
                data.append(n.astype("<i2" if fits else "<i4").tobytes())
                width.append(2 if fits else 4)
            else:
                data.append(x.astype("<f8").tobytes())
                width.append(8)
            kept.append(k)
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(data, pa.binary()), pa.array(width, pa.int32())], names=["vec_id", "label", "v", "wide"])


def decoded(data: list[bytes], wide: int) -> np.ndarray:
    """The components as whole numbers: doubles, or objects of any size if ``wide`` is 8."""
    if wide < 8:
        return np.frombuffer(b"".join(data), f"<i{wide}").reshape(len(data), -1).astype(float)
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def squares(x: np.ndarray, entries: list[list[int]]) -> np.ndarray:
    """The exact squared distances of each row to each entry."""
    most = max((abs(v) for e in entries for v in e), default=0)
    if x.dtype != object and x.shape[1] * (int(np.abs(x).max(initial=0)) + most) ** 2 < EXACT:
        c = np.array(entries, float).reshape(len(entries), -1)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    rows = [[int(v) for v in row] for row in x.tolist()]
    return np.array([[sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in entries] for row in rows], object).reshape(len(rows), len(entries))


def _norm(square) -> float:
    try:
        return math.sqrt(square)
    except OverflowError:
        return math.inf


def _norms(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square) if square.dtype != object else np.array([_norm(v) for v in square.tolist()], float)


def moves(history: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """own[s, p, j]: how far entry j of part p has come from round s to the last; other[s, p, j]: the farthest that any other entry has."""
    now, k = history[-1], len(history[-1][0])
    own = np.array([[[_norm(sum((a - b) ** 2 for a, b in zip(e, f, strict=True))) for e, f in zip(old[p], now[p], strict=True)] for p in range(PARTS)] for old in history]) * (1 + SLACK)
    other = np.zeros_like(own)
    for j in range(k):
        other[:, :, j] = np.delete(own, j, axis=2).max(axis=2, initial=0)
    return own, other


class Sums:
    """Counts and sums of the parts that join an entry less those that leave it."""

    def __init__(self, d: int, entries: int):
        self.edge, self.count = cuts(d), np.zeros((PARTS, entries), np.int64)
        self.sum = [np.zeros((entries, self.edge[p + 1] - self.edge[p]), object) for p in range(PARTS)]

    def add(self, p: int, x: np.ndarray, entry: np.ndarray, sign: int) -> None:
        n = self.count.shape[1]
        self.count[p] += sign * np.bincount(entry, minlength=n)
        if x.dtype == object:
            np.add.at(self.sum[p], entry, sign * x)
        else:  # less than ROWS numbers below 2**31: exact in doubles
            total = (entry[None, :] == np.arange(n)[:, None]).astype(float) @ x
            self.sum[p] = self.sum[p] + sign * total.astype(np.int64).astype(object)

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        """cell, limb, total: for each part and entry the count, then the sums by position."""
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        n, at = self.count.shape[1], 0
        for p in range(PARTS):
            for j in range(n):
                for v in (self.count[p, j], *self.sum[p][j].tolist()):
                    v, k = int(v), 0
                    while v:
                        piece = v if -(1 << 40) < v < 1 << 40 else v & ((1 << LIMB) - 1)
                        for column, x in zip(out, (at, k, piece), strict=True):
                            column.append(x)
                        v, k = (v - piece) >> LIMB, k + 1
                    at += 1
        return out


def reassigned(state: np.ndarray, x: np.ndarray, history: list[Codebook], moved: tuple[np.ndarray, np.ndarray], edge: list[int]) -> np.ndarray:
    """The state of each row's parts after an assignment to the last codebook; which were compared exactly have its stamp."""
    now, stamp = history[-1], len(history) - 1
    own, other = moved
    out = state.copy()
    for p in range(PARTS):
        s = state[:, p]
        if stamp:
            kept = s["upper"] + own[s["stamp"], p, s["entry"]] < s["lower"] - other[s["stamp"], p, s["entry"]]
            at = np.flatnonzero(~kept)
        else:
            at = np.arange(len(s))
        if not len(at):
            continue
        d = squares(x[at, edge[p] : edge[p + 1]], now[p])
        best = np.argmin(d, axis=1)
        rows = np.arange(len(at))
        least = d[rows, best]
        d[rows, best] = np.inf if d.dtype != object else 1 << 4096
        with np.errstate(over="ignore"):
            out["entry"][at, p], out["stamp"][at, p] = best, stamp
            out["upper"][at, p] = _norms(least) * (1 + SLACK)
            out["lower"][at, p] = np.minimum(_norms(d.min(axis=1)), 3e38) * (1 - SLACK)
    return out


def _round(history: list[Codebook], d: int, last: bool, label):
    moved, edge, n = moves(history), cuts(d), len(history[-1][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(d, n)
        for whole_batch in batches:
            for lo in range(0, len(whole_batch), ROWS):
                batch = whole_batch.slice(lo, ROWS)
                column = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
                wide, data, held = column["wide"].to_numpy(), column["v"].to_pylist(), column["state"].to_pylist()
                state = np.zeros((len(batch), PARTS), STATE)
                if len(history) > 1:
                    state = np.frombuffer(b"".join(held), STATE).reshape(len(batch), PARTS)
                new, error = state.copy(), [0] * len(batch)
                for w in np.unique(wide).tolist():
                    at = np.flatnonzero(wide == w)
                    x = decoded([data[k] for k in at], w)
                    new[at] = reassigned(state[at], x, history, moved, edge)
                    for p in range(PARTS):
                        entry, own = new["entry"][at, p], x[:, edge[p] : edge[p + 1]]
                        if last:
                            for j in np.unique(entry).tolist():
                                mine = np.flatnonzero(entry == j)
                                for k, v in zip(at[mine].tolist(), squares(own[mine], [history[-1][p][j]])[:, 0].tolist(), strict=True):
                                    error[k] += int(v)
                            continue
                        before = state["entry"][at, p]
                        change = np.flatnonzero(entry != before) if len(history) > 1 else np.arange(len(at))
                        if len(change):
                            sums.add(p, own[change], entry[change], 1)
                            if len(history) > 1:
                                sums.add(p, own[change], before[change], -1)
                if last:
                    code = ["".join(f"{e:02x}" for e in row) for row in new["entry"].tolist()]
                    yield pa.RecordBatch.from_arrays([column["vec_id"], column["label"], pa.array(code, pa.string()), pa.array([min(e, MOST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])
                else:
                    none = pa.nulls(len(batch), pa.int64())
                    raw = pa.array([row.tobytes() for row in new], pa.binary())
                    yield pa.RecordBatch.from_arrays([column["vec_id"], column["label"], column["v"], column["wide"], raw, none.cast(pa.int32()), none.cast(pa.int32()), none], names=["vec_id", "label", "v", "wide", "state", "cell", "limb", "total"])
        if not last:
            cell, limb, total = sums.rows()
            none = lambda kind: pa.nulls(len(cell), kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(label), none(pa.binary()), none(pa.int32()), none(pa.binary()), pa.array(cell, pa.int32()), pa.array(limb, pa.int32()), pa.array(total, pa.int64())], names=["vec_id", "label", "v", "wide", "state", "cell", "limb", "total"])

    return run


def compressed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebook]:
    """vec_id, label, code, error of each valid vector; and the codebooks by part, entry and position.

    Vectors that are null or hold null or non-finite components take no part, nor do those of another length than that of
    the least id. Components become floor(4096 * x). Codebooks begin as the parts of the 16 vectors with the least ids (of
    fewer, if there are fewer; null ids last, rows that share an id by their components) and are replaced six times by the
    floored means of the parts nearest to their entries, ties to the lower index; entries without parts stay. code: two hex
    digits for each part; error: the summed squared distances, at most 2**63 - 1. Parts of a length that eight does not
    divide differ by one component. Numbers of any size are compared exactly. An empty table gives no rows and empty
    codebooks. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.schema[label].dataType
    arrow = to_arrow_type(kind)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    base = [StructField("vec_id", LongType()), StructField("label", kind), StructField("v", BinaryType()), StructField("wide", IntegerType())]
    more = [StructField("state", BinaryType()), StructField("cell", IntegerType()), StructField("limb", IntegerType()), StructField("total", LongType())]
    ready = rows.mapInArrow(released(_packed), StructType(base))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = rows.filter(F.col("v").isNotNull() & ~F.exists("v", bad)).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v")
    first = [r["v"] for r in valid.limit(ENTRIES).collect()]
    d = len(first[0]) if first else 0
    if any(len(v) != d for v in first):
        first = [r["v"] for r in valid.filter(F.size("v") == d).limit(ENTRIES).collect()]
    one_length = F.octet_length("v") == d * F.col("wide")
    edge = cuts(d)
    start = [[whole(x) for x in v] for v in first]
    history: list[Codebook] = [[[v[edge[p] : edge[p + 1]] for v in start] for p in range(PARTS)]]
    held = ready.filter(one_length).withColumns({"state": F.lit(None).cast("binary"), "cell": F.lit(None).cast("int")})
    result = StructType([*base[:2], *StructType.fromDDL("code string, error long")])
    if not first:
        return vectors.sparkSession.createDataFrame([], result), history[0]
    n = len(first)
    counts = [[0] * n for _ in range(PARTS)]
    sums = [[[0] * (edge[p + 1] - edge[p]) for _ in range(n)] for p in range(PARTS)]
    for _ in range(ROUNDS):
        held = checkpointed(held.filter("cell is null").mapInArrow(released(_round(history, d, False, arrow)), StructType([*base, *more])))
        totals: dict[int, int] = {}
        for r in held.filter("cell is not null").groupBy("cell", "limb").agg(F.sum("total").alias("total")).collect():  # a few for each component of the codebooks
            totals[r["cell"]] = totals.get(r["cell"], 0) + (r["total"] << (LIMB * r["limb"]))
        at, now = 0, history[-1]
        following: Codebook = []
        for p in range(PARTS):
            following.append([])
            for j in range(n):
                counts[p][j] += totals.get(at, 0)
                for i in range(edge[p + 1] - edge[p]):
                    sums[p][j][i] += totals.get(at + 1 + i, 0)
                at += 1 + edge[p + 1] - edge[p]
                following[p].append([s // counts[p][j] for s in sums[p][j]] if counts[p][j] else now[p][j])
        history.append(following)
    return held.filter("cell is null").mapInArrow(released(_round(history, d, True, arrow)), result), history[-1]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, codebooks = compressed(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    found = checkpointed(found)
    told = hashlib.sha256(",".join(str(v) for part in codebooks for entry in part for v in entry).encode()).hexdigest()
    # a label may hold most of the rows: partial sums, and a join that Spark may split
    most = F.lit(MOST).cast("decimal(38,0)")
    of = found.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    return found.join(of, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def _sql() -> str:
    """Six rounds over one row for each vector, part and position."""
    nearest = lambda c: f"(SELECT r, p, min_by(j, (s, j)) AS j, min(s) AS s FROM (SELECT x.r, x.p, c.j, sum((x.v - c.v) * (x.v - c.v)) AS s FROM x JOIN {c} c USING (p, i) GROUP BY x.r, x.p, c.j) GROUP BY r, p)"
    steps = [
        f"a{k} AS MATERIALIZED {nearest(f'c{k}')}, m{k} AS (SELECT x.p, a.j, x.i, floor(sum(x.v) / count(*))::BIGINT AS v FROM x JOIN a{k} a USING (r, p) GROUP BY x.p, a.j, x.i), "
        f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.j, c.i, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, j, i))"
        for k in range(ROUNDS)
    ]
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT r, k // (d // 8) AS p, k % (d // 8) AS i, v FROM (SELECT r, len(embedding) AS d, unnest(range(len(embedding))) AS k, unnest(list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT)) AS v FROM e)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS j, i, v FROM x WHERE r <= 16),
{', '.join(steps)},
z AS MATERIALIZED {nearest(f'c{ROUNDS}')},
s AS (SELECT r, string_agg(printf('%02x', j::BIGINT), '' ORDER BY p) AS code, sum(s)::BIGINT AS error FROM z GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, j, i)) FROM c{ROUNDS}) AS codebooks_sha256 FROM s JOIN e USING (r)
"""


ORACLE = _sql()
