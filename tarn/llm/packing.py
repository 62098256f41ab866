"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths chooses bucket upper bounds that minimise padding; inside each
bucket, rows in key-hash order form batches whose padded size stays within the token budget. Lengths are words unless the
caller gives a length of its own (of token ids, say).

The driver gets the exact histogram only: one row a distinct length, and since distinct lengths add up to at most all
words, their number grows with the square root of the input's words at most. Bounds are optimal at any number of them.

Defined cases: a null or empty text has length 0 and is packed like any other; texts of any length are measured whole; a row
longer than the budget fits no batch, so it stands alone, unpadded, in one further bucket, and only such rows are marked
over_budget; repeated and null keys are rows like others, in any number; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import HOT_PARTS, stored

#: Rows of a bucket that one task ranks.
CELL_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\x09-\\x0D]+")).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over ascending lengths with the least total padding."""
    n = len(lengths)
    if n == 0:
        return []
    number, tokens, sizes = [0, *np.cumsum(counts).tolist()], [0, *np.cumsum(counts * lengths).tolist()], lengths.tolist()
    # padding of cells i .. j-1 in one bucket is sizes[j-1] * (number[j] - number[i]) - (tokens[j] - tokens[i]): for fixed i a
    # line in sizes[j-1] of slope -number[i], so a lower hull of lines gives the best i in O(n) a bucket, the least i of equals
    best = [0, *(x * k - t for x, k, t in zip(sizes, number[1:], tokens[1:], strict=True))]
    choice = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        now, back = [0] * (n + 1), [0] * (n + 1)
        hull, first = [], 0
        for j in range(1, n + 1):
            i, c = j - 1, best[j - 1] + tokens[j - 1]
            while len(hull) - first >= 2:
                (h, b), (g, a) = hull[-1], hull[-2]
                if (c - a) * (number[h] - number[g]) > (b - a) * (number[i] - number[g]):
                    break
                hull.pop()
            hull.append((i, c))
            x = sizes[j - 1]
            while first + 1 < len(hull) and hull[first + 1][1] - x * number[hull[first + 1][0]] < hull[first][1] - x * number[hull[first][0]]:
                first += 1
            i, c = hull[first]
            now[j], back[j] = c - x * number[i] + x * number[j] - tokens[j], i
        best = now
        choice.append(back)
    bounds, j = [], n
    for back in reversed(choice):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(back[j])
    return bounds[::-1]


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending lengths and their row counts."""
    cells = sorted(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    return np.array([r[0] for r in cells], np.int64), np.array([r[1] for r in cells], np.int64)


def lengths_of(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """(key, length, place) written once; place tells apart rows that repeat a key."""
    measured = word_count(F.col(text_col)) if length is None else length.cast("long")
    return stored(df.select(F.col(key_col).cast("long").alias("key"), measured.alias("length")).withColumn("place", F.monotonically_increasing_id()), "packing")


def pack(rows: DataFrame, budget: int = 8192, buckets: int = 16) -> DataFrame:
    """(key, length, bucket, bucket_length, batch, slot, padding, over_budget) for rows (key, length) such as those of lengths_of().

    Ranks inside a bucket come from a window over cells of about CELL_ROWS rows by key hash plus each cell's offset, so no
    task holds a bucket; all batches of a bucket but its last are full. A cell that repeated keys make several times as large
    is split by the rows' places.
    """
    if "place" not in rows.columns:
        rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "places")
    lengths, counts = histogram(rows)
    fit = lengths <= budget
    bounds = optimal_bounds(lengths[fit], counts[fit], buckets)
    in_bucket = [int(counts[(lengths <= b) & (lengths > a)].sum()) for a, b in zip([-1, *bounds], bounds, strict=False)]
    over = F.col("length") > budget

    def by_bound(values: list[int], otherwise: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for b, v in zip(bounds, values, strict=True):
            out = out.when(F.col("length") <= b, F.lit(v))
        return out.otherwise(otherwise).cast("long")

    parts = by_bound([-(-n // CELL_ROWS) or 1 for n in in_bucket], F.lit(max(1, -(-int(counts[~fit].sum()) // CELL_ROWS))))
    placed = rows.withColumn("bucket", by_bound(list(range(len(bounds))), F.lit(len(bounds))).cast("int")).withColumn("bucket_length", by_bound(bounds, F.col("length")))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("key"), parts))
    total = int(counts.sum())
    most = max(8 * CELL_ROWS, total // HOT_PARTS)
    # at most HOT_PARTS cells are that large
    large = placed.groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).withColumn("_split", F.ceil(F.col("_n") / CELL_ROWS))
    placed = placed.join(F.broadcast(large.drop("_n")), ["bucket", "cell"], "left")
    placed = placed.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("place"), F.col("_split")), F.lit(0))).drop("_split")
    sizes = placed.groupBy("bucket", "cell", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "cell", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "cell", "sub").orderBy("key", "length", "place")) - 1
    capacity = F.when(over, 1).otherwise(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    ranked = placed.withColumn("rank", rank).join(offsets, ["bucket", "cell", "sub"]).withColumn("rank", F.col("rank") + F.col("offset")).withColumn("capacity", capacity)
    return ranked.select(
        "key", "length", "bucket", "bucket_length", F.floor(F.col("rank") / F.col("capacity")).cast("long").alias("batch"), (F.col("rank") % F.col("capacity")).cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"), over.alias("over_budget"),
    )
