"""N-gram Jaccard self-join by the chosen-path method (after Christiani, Pagh and Sivertsen, "Scalable and Robust Set
Similarity Join", 2018).

A document is the set of its 5-word shingles; documents with equal sets are one set with a number of copies. A set's MinHash
coordinates are shared tokens sampled alike in all sets. Each of `runs` runs starts a tree of paths at one coordinate: sets
with the same sampled token share a bucket. A bucket of at most SMALL sets is brute-forced; a larger one splits on BRANCH
further sampled tokens, and so on. A bucket whose sets are so alike that splitting would not lower the number of comparisons
is compared in pairs of blocks instead, each bounded in memory, so no bucket is cut off. Runs are repeated until the expected
recall reaches `recall`: two sets of similarity s meet in none of R runs with probability (1 - s)^R, and a bucket that splits
loses them at a level with probability (1 - s)^BRANCH, at most LEVELS times, since later runs leave a pair to the first.

Before that, large classes of near copies become balls: of the sets that share a bucket of one of the first BALL_RUNS runs with at
least BALL others, those whose similarity to the bucket's pivot (the most typical of some of them) is at least 1 - (1 - s) / 2, exactly. Jaccard distance is a metric,
so all sets of a ball are linked with one another; their links are a sum, and no run compares them again. The cost of a class of
copies that lie that near to a pivot thus grows with its size, not with its square.

Pairs are made once: a bucket compares a pair only if no earlier run or sibling token has brought the two together. Brute
force in small buckets first compares byte sketches (pairs far below the threshold go), then the whole shingle sets, exactly;
blocks count shared shingles by matrix products, also exactly.

Defined cases: words are runs of digits, letters a-z (after lower-casing A-Z) and anything beyond ASCII; a text of 1 to 4
words is one shingle; texts of any length are taken whole; a text without words (null, empty) links to nothing; a row with a
null id links to nothing and has a null class; rows that repeat an id, with the same text or another, are rows like others, each
counted; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import HOT_PARTS, components, free_names, hot_lookup, may_be_among, stored
from tarn.llm.tokens import as_bytes, chunks, mix, slices, words

SHINGLE = 5
SMALL = 96
#: Bounds of a block, about twice what it is dealt: rows, and shingles of all its sets together.
BLOCK = 2048
BLOCK_SHINGLES = 1_000_000
BRANCH = 8
LEVELS = 6
#: Sets of a ball, at least; runs whose buckets make balls; of a sketch's values, how many a ball's set shares with the pivot's, at least
#: (a set that is missed by that is no loss, it goes the ordinary way).
BALL, BALL_RUNS, BALL_SKETCH = 128, 2, 36
#: Rows of a bucket that one task may walk; see _hot.
HOT_ROWS = 512
SKETCH = BRANCH * LEVELS
_rng = np.random.default_rng(77)
WEIGHTS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def expected_recall(threshold: float, runs: int) -> float:
    """A lower bound of the share of pairs at the threshold that are found."""
    return 1 - (1 - threshold) ** runs - LEVELS * (1 - threshold) ** BRANCH


def runs_for(threshold: float, recall: float) -> int:
    """The least number of runs whose expected recall at the threshold is at least `recall`."""
    left = 1 - recall - LEVELS * (1 - threshold) ** BRANCH
    if left <= 0:
        raise ValueError(f"a recall of {recall} at {threshold} needs a larger BRANCH")
    return max(1, math.ceil(math.log(left) / math.log(1 - threshold)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for low, high in chunks(texts):
        w = words(texts[low:high])
        h = w.hashes
        n = len(h) - SHINGLE + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for d in range(SHINGLE if n > 0 else 0):
            rolled += h[d : d + n] * WEIGHTS[d]
        rolled = mix(rolled)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(rolled[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * WEIGHTS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _minhash(s: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Coordinates of the set: for each function, the smallest hashed token."""
    best = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(s), 4096):
        part = s[low : low + 4096]
        h = part[None, :] * odd[:, None] + add[:, None]
        np.minimum(best, (h ^ (h >> np.uint64(31))).min(axis=1), out=best)
    return best


def signatures(df: DataFrame, runs: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, hash, sid, n, keys, sketch): the text's hash, and the digest of its shingle set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(4242)
        odd = rng.integers(1, 2**63, runs + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(1, 2**63, runs + SKETCH, dtype=np.uint64)
        for batch in slices(batches):
            sid, n, keys, sketch = [], [], [], []
            texts = as_bytes(batch.column(1))
            for low, high in chunks(texts):
                for s in shingle_sets(texts[low:high]):
                    n.append(len(s))
                    if not len(s):
                        sid.append(None), keys.append(None), sketch.append(None)
                        continue
                    m = _minhash(s, odd, add)
                    sid.append(set_digest(s)), keys.append(m[:runs].view(np.int64)), sketch.append(mix(m[runs:]).astype(np.uint8).tobytes())
            arrays = [batch.column(0), batch.column(2), pa.array(sid, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "hash", "sid", "n", "keys", "sketch"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    return rows.mapInArrow(run, "doc_id long, hash long, sid binary, n int, keys array<long>, sketch binary")


PATH = "bucket long, run int, level int, trail binary, sid binary, n int, keys array<long>, sketch binary, ball binary"
_PATH_COLUMNS = ["bucket", "run", "level", "trail", "sid", "n", "keys", "sketch", "ball"]


def _mean_agreement(sketch: np.ndarray) -> float:
    """Mean similarity of pairs of rows, from how often values agree by position."""
    m = len(sketch)
    same = sum(int((np.bincount(sketch[:, p], minlength=256).astype(np.int64) ** 2).sum()) - m for p in range(sketch.shape[1]))
    return same / (sketch.shape[1] * m * (m - 1))


def _own_pairs(rows: list[tuple], sides: list[int] | None, threshold: float) -> np.ndarray:
    """Matrix, upper half: pairs that are this bucket's to compare and whose sizes allow the threshold."""
    run, trail = rows[0][1], rows[0][3]
    m = len(rows)
    n = np.array([r[5] for r in rows])
    ok = np.triu(np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9, 1)
    if sides is not None:
        side = np.array(sides)
        ok &= side[:, None] != side[None, :]
    number: dict[bytes, int] = {}
    ball = np.array([-1 if r[8] is None else number.setdefault(r[8], len(number)) for r in rows])
    if number:
        ok &= (ball[:, None] != ball[None, :]) | (ball < 0)[:, None]
    if run:
        keys = np.array([r[6][:run] for r in rows])
        for k in range(run):
            ok &= keys[:, k, None] != keys[None, :, k]
    if trail:
        sketch = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(m, SKETCH)
        for depth, chosen in enumerate(trail):
            for j in range(chosen):
                column = sketch[:, depth * BRANCH + j]
                ok &= column[:, None] != column[None, :]
    return ok


def _candidates(rows: list[tuple], threshold: float, sketch_least: int) -> list[tuple[int, int]]:
    """Index pairs of a small bucket that are its own and whose sketches allow the threshold."""
    a, b = np.nonzero(_own_pairs(rows, None, threshold))
    if not len(a):
        return []
    sketch = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), SKETCH)
    near = (sketch[a] == sketch[b]).sum(axis=1) >= sketch_least
    return list(zip(a[near].tolist(), b[near].tolist(), strict=True))


def _children(row: tuple) -> Iterator[tuple]:
    bucket, run, level, trail, sid, n, keys, sketch, ball = row
    for j in range(BRANCH):
        value = sketch[(level - 1) * BRANCH + j]
        child = int.from_bytes(hashlib.blake2b(b"%d:%d:%d" % (bucket, j, value), digest_size=8).digest(), "little", signed=True)
        yield (child, run, level + 1, trail + bytes([j]), sid, n, keys, sketch, ball)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


OUT = f"{PATH}, kind int, partners array<binary>"
LEAF, CHILD, DENSE = 0, 1, 2


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.binary())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_PATH_COLUMNS, "kind", "partners"])


def _leaf_rows(rows: list[tuple], pairs: list[tuple[int, int]], leaf: int) -> list[tuple]:
    partners: dict[int, list[bytes]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(rows[b][4])
        partners.setdefault(b, [])
    return [(leaf, None, None, None, rows[i][4], rows[i][5], None, None, None, LEAF, p) for i, p in partners.items()]


def _walk(threshold: float, sketch_least: int):
    """One level of all paths: rows (path columns, mode) come sorted by bucket; a row with a mode makes its children, alone. At most
    SMALL + 1 rows of a bucket are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        bucket = state = None  # state of a large bucket: CHILD or DENSE

        def close() -> None:
            if state is None and len(held) > 1:
                out.extend(_leaf_rows(held, _candidates(held, threshold, sketch_least), held[0][0]))

        def large(row: tuple, kind: int) -> None:
            if kind == CHILD:
                out.extend((*c, CHILD, None) for c in _children(row))
            else:
                out.append((*row, DENSE, None))

        for *row, mode in _grouped(batches):
            if mode is not None:
                large(row, mode)
            else:
                if row[0] != bucket:
                    close()
                    bucket, held, state = row[0], [], None
                if state is not None:
                    large(row, state)
                else:
                    held.append(row)
                    if len(held) > SMALL:
                        sketch = np.frombuffer(b"".join(r[7] for r in held), np.uint8).reshape(len(held), SKETCH)
                        state = DENSE if row[2] > LEVELS or _mean_agreement(sketch) * BRANCH >= 1 else CHILD
                        for r in held:
                            large(r, state)
                        held = []
            if len(out) >= 4096:
                yield _emit(out)
                out.clear()
        close()
        yield _emit(out)

    return run


def _drawn(rows: DataFrame, buckets: DataFrame, of_bucket: Callable[[list[tuple]], tuple], schema: str) -> DataFrame:
    """What of_bucket makes of about SMALL rows (bucket, sid, sketch), drawn by their hash, of each of buckets(bucket, _rows)."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for row in _grouped(batches):
            if held and row[0] != held[0][0]:
                out.append(of_bucket(held))
                held = []
            held.append(row)
        if held:
            out.append(of_bucket(held))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    some = rows.select("bucket", "sid", "sketch").join(buckets.select("bucket", "_rows"), "bucket")
    some = some.filter(F.pmod(F.xxhash64("sid"), F.greatest(F.lit(1), F.floor(F.col("_rows") / SMALL))) == 0).select("bucket", "sid", "sketch")
    return some.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _medoid(held: list[tuple]) -> tuple:
    """(bucket, sid, sketch) of the row whose sketch agrees most with the others'."""
    sketch = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), SKETCH)
    return held[int((sketch[:, None, :] == sketch[None, :, :]).sum(axis=(1, 2)).argmax())]


def _near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (pivot, sid, pivot_sketch, sketch), the (pivot, sid) whose sketches agree in BALL_SKETCH values."""
    for batch in slices(batches, 4096):
        pivots, sids, a, b = (c.to_pylist() for c in batch.columns)
        own, of_pivot = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, SKETCH) for x in (b, a))
        near = np.flatnonzero((own == of_pivot).sum(axis=1) >= BALL_SKETCH).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in near], pa.binary()) for x in (pivots, sids)], ["pivot", "sid"])


def _in_ball(least: float):
    """Of rows (pivot, salt, first, sid, text) sorted by pivot, salt and first, the sets at least that similar to the pivot, which is the
    first of its rows; a text's shingles are compared with the pivot's, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, np.zeros(0, np.uint64)
        for batch in slices(batches, 256):
            pivots, salts, _, sids, _ = (c.to_pylist() if k < 4 else None for k, c in enumerate(batch.columns))
            out = []
            for p, salt, sid, s in zip(pivots, salts, sids, shingle_sets(as_bytes(batch.column(4))), strict=True):
                if (p, salt) != at:
                    at, pivot = (p, salt), s
                shared = len(np.intersect1d(pivot, s, assume_unique=True))
                if set_digest(s) == sid and shared >= least * (len(pivot) + len(s) - shared):
                    out.append((sid, p))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(2)], ["sid", "ball"])

    return run


def balls(sets: DataFrame, texts_of: Callable[[DataFrame], DataFrame], threshold: float, runs: int) -> DataFrame:
    """(sid, ball): sets that lie so near to a pivot that all of them are linked; a written table. A set is in one ball at most."""
    found = None
    for run in range(min(BALL_RUNS, runs)):
        rows = sets if found is None else sets.join(found, "sid", "left_anti")
        rows = rows.select("sid", "sketch", F.xxhash64(F.lit(run), F.col("keys")[run]).alias("bucket"))
        large = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= BALL), f"large{run}")
        pivots = _drawn(rows, large, _medoid, "bucket long, pivot binary, pivot_sketch binary")
        met = rows.join(pivots, "bucket").select("pivot", "sid", "pivot_sketch", "sketch")
        near = stored(met.mapInArrow(_near_pivots, "pivot binary, sid binary"), f"near{run}")
        sizes = stored(near.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= BALL), f"pivots{run}")
        if sizes.isEmpty():
            continue
        near = near.join(sizes, "pivot")
        texts = texts_of(near.select("sid").union(sizes.select(F.col("pivot").alias("sid"))).distinct())
        parts = F.ceil(F.col("m") / HOT_ROWS).cast("long")
        members = near.filter("sid <> pivot").select("pivot", F.pmod(F.xxhash64("sid"), parts).alias("salt"), F.lit(1).alias("first"), "sid")
        firsts = sizes.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"), F.lit(0).alias("first"), F.col("pivot").alias("sid"))
        dealt = members.unionByName(firsts).join(texts.select("sid", "text"), "sid").select("pivot", "salt", "first", "sid", "text")
        dealt = dealt.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "first", "sid")
        own = dealt.mapInArrow(_in_ball(1 - (1 - threshold) / 2 + 1e-9), "sid binary, ball binary").distinct()
        more = stored(own, f"balls{run}")
        found = more if found is None else stored(found.unionByName(more), f"all_balls{run}")
    return found if found is not None else sets.select("sid", F.col("sid").alias("ball")).limit(0)


def _hot(rows: DataFrame, total: int) -> DataFrame | None:
    """(bucket, rows, shingles, mean similarity) of buckets that hold over total / HOT_PARTS rows, and HOT_ROWS at least. The mean, by
    which a bucket splits or goes in blocks, is that of about SMALL of its rows, drawn by their hash; either way gives the same pairs."""
    limit = max(HOT_ROWS, total // HOT_PARTS)
    hot = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_shingles")).filter(F.col("_rows") > limit), "hot")
    if hot.isEmpty():
        return None

    def mean(held: list[tuple]) -> tuple:
        return held[0][0], _mean_agreement(np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), SKETCH)) if len(held) > 1 else 1.0

    return stored(hot.join(_drawn(rows, hot, mean, "bucket long, _mean double"), "bucket", "left").withColumn("_mean", F.coalesce("_mean", F.lit(1.0))), "agreement")


def candidates(sets: DataFrame, runs: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """(leaf, sid, partners): for each small bucket, the sets in pairs that may reach the threshold; and the rows of block
    pairs (path columns, at), with `at` the row's side, 0 where both sides are one block. Written tables."""
    sketch_least = int(SKETCH * (threshold - 0.38))
    rows = sets.select(F.posexplode("keys").alias("run", "key"), "sid", "n", "keys", "sketch", "ball").filter(F.col("run") < runs)
    rows = rows.select(F.xxhash64("run", "key").alias("bucket"), "run", F.lit(1).alias("level"), F.lit(b"").alias("trail"), "sid", "n", "keys", "sketch", "ball")
    leaves, dense = [], []
    for level in range(1, LEVELS + 3):
        total = rows.count()
        if total < 2:
            break
        hot = _hot(rows, total)
        rows = rows.withColumn("mode", F.lit(None).cast("int"))
        if hot is not None:
            marked = rows.drop("mode").join(F.broadcast(hot), "bucket", "left")
            splits = (F.col("_mean") * BRANCH < 1) & (F.col("level") <= LEVELS)
            dense.append(marked.filter(F.col("_mean").isNotNull() & ~splits).select(*_PATH_COLUMNS))
            rows = marked.filter(F.col("_mean").isNull() | splits).select(*_PATH_COLUMNS, F.when(splits, F.lit(CHILD)).alias("mode"))
        # the rows of a hot bucket that splits need not meet: each makes its own children, wherever it is dealt to
        dealt = rows.withColumn("salt", F.when(F.col("mode").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("sid"), F.lit(4096))))
        dealt = dealt.repartition("bucket", "salt").drop("salt").sortWithinPartitions("bucket", "sid")
        walked = stored(dealt.mapInArrow(_walk(threshold, sketch_least), OUT), f"level{level}")
        leaves.append(walked.filter(F.col("kind") == LEAF).select(F.col("bucket").alias("leaf"), "sid", "partners"))
        dense.append(walked.filter(F.col("kind") == DENSE).select(*_PATH_COLUMNS))
        rows = walked.filter(F.col("kind") == CHILD).select(*_PATH_COLUMNS)
    all_dense = None
    for d in dense:
        all_dense = d if all_dense is None else all_dense.unionByName(d)
    if all_dense is not None and not all_dense.isEmpty():
        # a ball's rows of a bucket and the rows without a ball are dealt to blocks apart, and two blocks of one ball do not meet; other
        # rows of a bucket of m make m / BLOCK rows a row: pairs of blocks, not pairs of sets
        count = F.ceil(F.greatest(F.count(F.lit(1)) / (BLOCK // 2), F.sum("n") / (BLOCK_SHINGLES // 2))).cast("long")
        parts = all_dense.groupBy("bucket", "ball").agg(count.alias("parts"))
        parts = parts.groupBy("bucket").agg(F.collect_list(F.struct("ball", "parts")).alias("groups"))
        placed = all_dense.join(parts, "bucket").withColumn("own", F.filter("groups", lambda g: g["ball"].eqNullSafe(F.col("ball")))[0]["parts"])
        at = F.struct(F.coalesce("ball", F.lit(b"")).alias("b"), F.pmod(F.xxhash64("sid"), F.col("own")).alias("k"))
        others = F.filter("groups", lambda g: ~(g["ball"].isNotNull() & g["ball"].eqNullSafe(F.col("ball"))))
        blocks_of = F.flatten(F.transform(others, lambda g: F.transform(F.sequence(F.lit(0).cast("long"), g["parts"] - 1), lambda k: F.struct(F.coalesce(g["ball"], F.lit(b"")).alias("b"), k.alias("k")))))
        paired = placed.withColumn("at", at).withColumn("other", F.explode(blocks_of))
        low, high = F.least("at", "other"), F.greatest("at", "other")
        side = F.when(low == high, 0).when(F.col("at") == low, 1).otherwise(2).cast("long")
        blocks = stored(paired.select(F.xxhash64("bucket", low, high).alias("bucket"), *_PATH_COLUMNS[1:], side.alias("at")), "blocks")
    else:
        blocks = None
    out = leaves[0] if leaves else sets.select(F.lit(0).cast("long").alias("leaf"), "sid", F.array("sid").alias("partners")).limit(0)
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, blocks


LINKS = "sid binary, links long, root binary"


def _link_batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["sid", "links", "root"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of shared shingles: products of 0/1 columns, a slice of the shingles that at least two sets hold at a time."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    common = count > 1
    column = np.cumsum(common) - 1
    use = common[number]
    owner, number = owner[use], column[number[use]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for low in range(0, int(common.sum()), width):
        a, b = np.searchsorted(number, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], number[a:b] - low] = 1
        total += part @ part.T
    return total


def _verify_blocks(threshold: float):
    """Exact links in pairs of blocks: rows (path columns, at, copies, text) come sorted by bucket."""

    def of_pair(held: list[tuple]) -> list[tuple]:
        made = shingle_sets([r[11] for r in held])
        true = [i for i, s in enumerate(made) if set_digest(s) == held[i][4]]
        held, made = [held[i] for i in true], [made[i] for i in true]
        if len(held) < 2:
            return []
        sides = [r[9] for r in held]
        ok = _own_pairs(held, sides if any(sides) else None, threshold)
        n = np.array([len(s) for s in made], np.float64)
        shared = _shared(made)
        ok &= shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
        ok |= ok.T
        links = ok.astype(np.float64) @ np.array([r[10] for r in held], np.float64)
        label = np.arange(len(held))
        while True:
            low = np.where(ok, label[None, :], len(held)).min(axis=1)
            new = np.minimum(label, low)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        return [(r[4], int(k), held[root][4]) for r, k, root in zip(held, links, label, strict=True) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches):
            columns = [c.to_pylist() for c in batch.columns[:-1]] + [as_bytes(batch.column(batch.num_columns - 1))]
            for row in zip(*columns, strict=True):
                if held and row[0] != held[0][0]:
                    yield _link_batch(of_pair(held))
                    held = []
                held.append(row)
        yield _link_batch(of_pair(held) if held else [])

    return run


def _verify(threshold: float):
    """Exact Jaccard similarity of the listed pairs; rows (leaf, sid, partners, copies, text) come sorted by leaf."""

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        shared = int((b[at] == a).sum())
        return shared >= threshold * (len(a) + len(b) - shared) - 1e-9

    def of_leaf(held: list[tuple]) -> list[tuple]:
        made = shingle_sets([r[4] for r in held])
        sets = {sid: s for (_, sid, *_), s in zip(held, made, strict=True) if set_digest(s) == sid}
        copies = {r[1]: r[3] for r in held}
        root, links = {s: s for s in sets}, dict.fromkeys(sets, 0)

        def find(x: bytes) -> bytes:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for _, sid, partners, *_ in held:
            for other in partners:
                if sid in sets and other in sets and similar(sets[sid], sets[other]):
                    links[sid] += copies[other]
                    links[other] += copies[sid]
                    a, b = sorted((find(sid), find(other)))
                    root[b] = a
        return [(s, n, find(s)) for s, n in links.items() if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        for batch in slices(batches):
            columns = [c.to_pylist() for c in batch.columns[:4]] + [as_bytes(batch.column(4))]
            for row in zip(*columns, strict=True):
                if held and row[0] != held[0][0]:
                    out += of_leaf(held)
                    held = []
                    if len(out) > 4096:
                        yield _link_batch(out)
                held.append(row)
        if held:
            out += of_leaf(held)
        yield _link_batch(out)

    return run


def _decided(df: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> DataFrame:
    """(doc_id, hash, n_links, copies, set_id, class_id, class_hash) for each row of df; null beyond `hash` for rows that link
    to nothing by definition. A class is known by its smallest (id, hash of text)."""
    runs = runs_for(threshold, recall)
    signed = stored(signatures(df, runs, id_col, text_col), "signatures")
    alive = signed.filter("sid is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "hash", "n", "keys", "sketch")).alias("f")
    sets = alive.groupBy("sid").agg(first, F.count(F.lit(1)).alias("copies"))
    sets = stored(sets.select("sid", "copies", F.col("f.doc_id").alias("set_id"), F.col("f.hash").alias("set_hash"), "f.n", "f.keys", "f.sketch"), "sets")
    known = sets.select("sid", "copies", "set_id", "set_hash")

    def texts_of(sids: DataFrame, name: str = "texts") -> DataFrame:
        """(sid, copies, text) of the sets, each once; a written table."""
        own = ["set_id", "set_hash"]
        needed = stored(sids.join(known, "sid"), f"needed_{name}")
        rows = df.select(F.col(id_col).cast("long").alias("set_id"), F.xxhash64(text_col).alias("set_hash"), F.col(text_col).alias("text"))
        rows = may_be_among(rows, own, needed, needed.count())
        return stored(rows.dropDuplicates(own).join(needed, own).select("sid", "copies", "text"), name)

    in_balls = balls(sets, texts_of, threshold, runs)
    sets = stored(sets.join(in_balls, "sid", "left"), "sets_and_balls")
    pairs, blocks = candidates(sets.select("sid", "n", "keys", "sketch", "ball"), runs, threshold)
    needed = pairs.select("sid").union(blocks.select("sid")) if blocks is not None else pairs.select("sid")
    texts = texts_of(needed.distinct())
    listed = pairs.join(texts, "sid").select("leaf", "sid", "partners", "copies", "text")
    linked = listed.repartition("leaf").sortWithinPartitions("leaf", "sid").mapInArrow(_verify(threshold), LINKS)
    if blocks is not None:
        listed = blocks.join(texts, "sid").select(*_PATH_COLUMNS, "at", "copies", "text")
        linked = linked.unionByName(listed.repartition("bucket").sortWithinPartitions("bucket", "sid").mapInArrow(_verify_blocks(threshold), LINKS))
    inside = sets.filter("ball is not null").select("sid", "copies", "ball")
    sizes = inside.groupBy("ball").agg(F.sum("copies").alias("all"))
    linked = linked.unionByName(inside.join(sizes, "ball").select("sid", (F.col("all") - F.col("copies")).alias("links"), F.col("ball").alias("root")))
    linked = stored(linked, "links")
    roots = components(linked.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    counted = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    placed = known.join(counted, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "sid")), "placed")
    classes = placed.groupBy("root").agg(F.min(F.struct("set_id", "set_hash")).alias("c"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    facts = placed.join(classes, "root").select("sid", "copies", "set_id", F.col("c.set_id").alias("class_id"), F.col("c.set_hash").alias("class_hash"), n_links)
    rows = signed.select("doc_id", "hash", F.when(F.col("doc_id").isNotNull(), F.col("sid")).alias("sid"))
    return hot_lookup(rows, stored(facts, "facts"), ["sid"], "copies", signed.count(), F.struct("doc_id", "hash")).drop("sid")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.99998) -> DataFrame:
    """(doc_id, class_id, n_links, set_id, copies) for each row of df.

    class_id is the smallest id that links (J >= threshold, over any chain) lead to; n_links counts the other rows whose set
    reaches the threshold with this row's; set_id is the smallest id with an equal set and copies the number of such rows.
    """
    found = _decided(df, id_col, text_col, threshold, recall)
    own = lambda c: F.coalesce(c, F.col("doc_id"))
    return found.select("doc_id", own(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own(F.col("set_id")).alias("set_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.99998) -> DataFrame:
    """The rows of df that stay, all columns: of each class one row, that with the smallest (id, hash of text); of rows that repeat
    both, one. Rows with a null id and rows without words stay, all of them."""
    made = _decided(df, id_col, text_col, threshold, recall).filter("class_id is not null")
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("hash") == F.col("class_hash"))
    id_, hash_ = own = free_names(df, "id", "hash")
    named = [F.col("doc_id").alias(id_), F.col("hash").alias(hash_)]
    decided = stored(made.withColumn("first", first), "decided")
    gone = decided.filter(~F.col("first")).select(*named).distinct()
    rows = df.withColumn(id_, F.col(id_col).cast("long")).withColumn(hash_, F.xxhash64(text_col))
    stay = rows.join(gone, own, "left_anti")
    repeated = stored(decided.filter("first").select(*named).groupBy(*own).count().filter("count > 1").select(*own), "repeated")
    if not repeated.isEmpty():
        stay = stay.join(repeated, own, "left_anti").unionByName(stay.join(repeated, own, "left_semi").dropDuplicates(own))
    return stay.select(*df.columns)
