"""Hard-negative mining over a vector-approximation file.

Vectors are of integers; scores are inner products. Each dimension is cut into CELLS cells at quantiles of all rows; a vector's
approximation is the cells it lies in, four bits a dimension, two dimensions a byte. For an anchor, a table of each pair of
dimensions gives the least and the greatest contribution of each pair of cells, so sums of looked-up values are lower and upper bounds
of a row's score. Only rows that may enter a result by their bounds are scored exactly:

* positives: rows of the anchor's label whose upper bound reaches the k-th greatest lower bound;
* negatives: rows of other labels whose bounds meet a positive's window of scores, and whose upper bound reaches the k-th greatest
  lower bound of rows that are surely not above it.

The file is dealt into slots of about SLOT_ROWS rows, the anchors into blocks of about ANCHOR_BLOCK, both by hash; each task meets one block
with one slot, so no label and no vector that many rows share is one task's work, and only each anchor's best rows leave it.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; rows that agree in id,
label and vector count once; rows that share an anchor's id are not its positives; a shorter vector has zeros for what it lacks;
cells and scores beyond 64 bits are clipped to them; ties go to the smaller id; a positive whose window is empty or holds no row gives no
rows; an empty table, or one without anchors, gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import stored

CELLS = 16
SLOT_ROWS = 8192
ANCHOR_BLOCK = 2048
#: Anchors whose bounds are held at once.
ANCHORS_AT_ONCE = 64


def as_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, computed in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, each once."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, as_integers(F.col(vector_col), scale)).alias("v"))
    return rows.filter("id is not null and label is not null and v is not null").dropDuplicates()


@dataclass(frozen=True)
class Marks:
    """Cell c of dimension d holds the integers low[d, c] to high[d, c]."""

    low: np.ndarray
    high: np.ndarray

    @property
    def reach(self) -> int:
        """No component is further from zero."""
        return max([0, -int(self.low.min()), int(self.high.max())]) if self.low.size else 0

    @property
    def kind(self) -> str:
        """The narrowest integers that hold every component."""
        return next((k for k, bits in (("<i2", 15), ("<i4", 31)) if self.reach < 1 << bits), "<i8")

    def codes(self, v: np.ndarray) -> np.ndarray:
        """Approximations of the rows of v: two dimensions a byte."""
        cells = np.zeros((len(v), v.shape[1] + v.shape[1] % 2), np.uint8)
        for d in range(v.shape[1]):
            cells[:, d] = np.searchsorted(self.low[d, 1:], v[:, d], side="right")
        return cells[:, 0::2] * np.uint8(CELLS) + cells[:, 1::2]

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors (a, d): least and greatest contributions (d / 2, CELLS^2, a) of each pair of cells."""
        ends = [anchors.T[:, None, :] * side[:, :, None] for side in (self.low.astype(anchors.dtype), self.high.astype(anchors.dtype))]
        out = []
        for pick in (np.minimum, np.maximum):
            one = pick(*ends)
            if len(one) % 2:
                one = np.concatenate([one, np.zeros_like(one[:1])])
            out.append((one[0::2, :, None, :] + one[1::2, None, :, :]).reshape(-1, CELLS * CELLS, one.shape[2]))
        return out[0], out[1]


def marks_of(rows: DataFrame) -> Marks:
    """Cells with about as many rows each, from quantiles of every dimension over all rows; zero lies in a cell too, as vectors may be short.

    Only CELLS + 1 numbers a dimension reach the driver."""
    at = F.posexplode("v").alias("d", "x")
    shares = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    found = rows.select(at).groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", shares, F.lit(1000)).alias("cuts")).collect()
    low, high = np.zeros((len(found), CELLS), np.int64), np.zeros((len(found), CELLS), np.int64)
    for r in found:
        low[r["d"]] = [min(0, r["least"]), *r["cuts"]]
        high[r["d"]] = [*(max(c - 1, low[r["d"], 0]) for c in r["cuts"]), max(0, r["most"])]
    return Marks(low, high)


def approximated(rows: DataFrame, marks: Marks) -> DataFrame:
    """The vector-approximation file: (id, label, key, codes, exact); key tells apart rows of one id."""
    kind, dims = np.dtype(marks.kind), len(marks.low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            v = np.zeros((len(lists), dims), np.int64)
            owner = np.repeat(np.arange(len(lists)), lengths)
            v[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
            made = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (marks.codes(v), v.astype(kind))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["id", "label", "key", "codes", "exact"])

    keyed = rows.select("id", "label", F.xxhash64("id", "label", "v").alias("key"), "v")
    return keyed.mapInArrow(run, "id long, label long, key long, codes binary, exact binary")


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), len(column.iloc[0]) // np.dtype(kind).itemsize)


class Slot:
    """Rows of one slot, and the anchors of one block, as arrays."""

    def __init__(self, anchors: pd.DataFrame, rows: pd.DataFrame, marks: Marks):
        self.marks, self.ids, self.labels, self.keys = marks, rows["id"].to_numpy(), rows["label"].to_numpy(), rows["key"].to_numpy()
        bound = max(1, len(marks.low)) * marks.reach**2
        self.wide = bound >= 1 << 62
        exact = np.float64 if bound < 1 << 53 else object if self.wide else np.int64
        self.bound_kind = np.int32 if bound < 1 << 31 else np.int64
        self.codes = _matrix(rows["codes"], "u1").astype(np.intp)
        self.v, self.anchors = (_matrix(x["exact"], marks.kind).astype(exact) for x in (rows, anchors))
        self.of_label: dict[tuple[int, bool], np.ndarray] = {}

    def rows_of(self, label: int, same: bool) -> np.ndarray:
        if (label, same) not in self.of_label:
            self.of_label[label, same] = np.flatnonzero((self.labels == label) == same)
        return self.of_label[label, same]

    def bounds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, lower, upper) for each anchor: bounds of all rows' scores, summed from looked-up contributions."""
        for first in range(0, len(self.anchors), ANCHORS_AT_ONCE):
            some = self.anchors[first : first + ANCHORS_AT_ONCE]
            if self.wide:
                for i in range(len(some)):
                    yield first + i, np.full(len(self.ids), -(1 << 63)), np.full(len(self.ids), (1 << 63) - 1)
                continue
            sides = []
            for table in self.marks.tables(some.astype(self.bound_kind)):
                total = np.zeros((len(self.ids), len(some)), self.bound_kind)
                for pair, column in zip(table, self.codes.T, strict=True):
                    total += pair.take(column, axis=0)
                sides.append(np.ascontiguousarray(total.T))
            for i in range(len(some)):
                yield first + i, sides[0][i], sides[1][i]

    def scores(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        made = self.v[rows] @ self.anchors[anchor]
        return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in made], np.int64) if self.wide else made.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best, by score, then smaller id."""
        return np.lexsort((self.keys[rows], self.ids[rows], -scores.astype(object) if self.wide else -scores))[:k]


def _kth(values: np.ndarray, k: int) -> int | None:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def window(score: int, percent: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest integers s with low * score <= 100 * s <= high * score."""
    q, r = divmod(int(score), 100)
    return percent[0] * q - (-percent[0] * r) // 100, percent[1] * q + percent[1] * r // 100


def _dealt(file: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> tuple:
    """Anchors by (block, slot) and rows by (block, slot): every block meets every slot."""
    slots, blocks = max(1, -(-n_rows // SLOT_ROWS)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    part = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.withColumn("block", part(blocks)).withColumn("slot", every(slots))
    held = file.withColumn("slot", part(slots)).withColumn("block", every(blocks))
    return asked.groupBy("block", "slot"), held.groupBy("block", "slot")


def positives(file: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, marks: Marks, k: int) -> DataFrame:
    """(id, key, place, positive_id, positive_score): each anchor's k best other rows of its label."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            slot, own = Slot(left, right, marks), left[["id", "key", "label"]].to_numpy()
            for i, lower, upper in slot.bounds():
                rows = slot.rows_of(own[i, 2], True)
                rows = rows[slot.ids[rows] != own[i, 0]]
                least = _kth(lower[rows], k)
                rows = rows if least is None else rows[upper[rows] >= least]
                scores = slot.scores(i, rows)
                out += [(own[i, 0], own[i, 1], slot.ids[rows[j]], slot.keys[rows[j]], scores[j]) for j in slot.best(rows, scores, k)]
        return pd.DataFrame(out, columns=["id", "key", "positive_id", "positive_key", "positive_score"]).astype("int64")

    asked, held = _dealt(file, anchors, n_rows, n_anchors)
    found = asked.cogroup(held).applyInPandas(run, "id long, key long, positive_id long, positive_key long, positive_score long")
    order = Window.partitionBy("id", "key").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("positive_key")


def negatives(file: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, marks: Marks, k: int, percent: tuple[int, int]) -> DataFrame:
    """(id, key, place, rank, negative_id, negative_score): of anchors with arrays places and scores of their positives, the k best rows of
    other labels in each positive's window."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            slot, own = Slot(left, right, marks), left[["id", "key", "label"]].to_numpy()
            for i, lower, upper in slot.bounds():
                rows = slot.rows_of(own[i, 2], False)
                windows = [window(s, percent) for s in left["scores"].iloc[i]]
                low, up, may = lower[rows], upper[rows], np.zeros(len(rows), bool)
                for least, most in set(windows):
                    if least <= most:
                        kth = _kth(low[up <= most], k)
                        may |= (low <= most) & (up >= (least if kth is None else max(least, kth)))
                rows = rows[may]
                scores = slot.scores(i, rows)
                for place, (least, most) in zip(left["places"].iloc[i], windows, strict=True):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    out += [(own[i, 0], own[i, 1], place, slot.ids[rows[j]], slot.keys[rows[j]], scores[j]) for j in inside[slot.best(rows[inside], scores[inside], k)]]
        return pd.DataFrame(out, columns=["id", "key", "place", "negative_id", "negative_key", "negative_score"]).astype("int64")

    asked, held = _dealt(file, anchors, n_rows, n_anchors)
    found = asked.cogroup(held).applyInPandas(run, "id long, key long, place long, negative_id long, negative_key long, negative_score long")
    order = Window.partitionBy("id", "key", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("negative_key")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of usable() rows.

    A negative lies in the window percent[0] * positive_score <= 100 * negative_score <= percent[1] * positive_score.
    """
    rows = stored(rows, "vectors")
    marks = marks_of(rows)
    file = stored(approximated(rows, marks), "approximations")
    anchors = stored(file.filter(is_anchor).drop("codes"), "anchors")
    sizes = (file.count(), anchors.count())
    found = stored(positives(file, anchors, *sizes, marks, n_positives), "positives")
    held = found.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asked = anchors.join(held, ["id", "key"]).withColumns({"places": F.col("p.place"), "scores": F.col("p.positive_score")}).drop("p")
    made = negatives(file, asked, *sizes, marks, n_negatives, percent)
    made = made.join(found, ["id", "key", "place"])
    return made.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
