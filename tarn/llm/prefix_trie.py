"""A prefix trie over conversations, with subtree sums by heavy-path decomposition.

A node of depth d is a distinct sequence of d turns (role, text); a conversation is a member of the node of each of its
prefixes, the empty one included.

* prefixes: each turn is hashed with its place; a running XOR of two such hashes names a prefix by 128 bits, so a node's
  parent is known without a join. Running values are scanned in segments of SEGMENT turns, then over segments, so a
  conversation of any length is no single task's work.
* heavy paths: a node's heavy child is the one with most members (of equal ones, with the smallest id). A light child has at
  most half its parent's members, so a path from the root has at most log2(conversations) light edges. The top of a node's
  path is the last light edge of its smallest member, another running value.
* sums: from the deepest level of light edges up, suffix sums along each path's array of nodes; the sum at a path's top is
  added to the node it hangs on, one level up. One round a level.
* members that end at a node are listed in the order of their ids, in pieces of PIECE_BYTES made by range-sorted tasks; one digest
  runs over the pieces, in bounded memory.

Defined cases: a null role or text is empty; turns are in order of (turn, role, text), null turns first, and repeated rows are
turns of their own; rows without a conversation id take no part; a conversation without turns is a member of the root; an empty
table has no conversations, so no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tarn.llm.common import hot_lookup, stored

#: Places of a sequence that one window scans.
SEGMENT = 1024
#: Bytes of an id list that one row holds.
PIECE_BYTES = 1 << 16
#: Turns that a conversation can take from another.
MAX_GRAFT = 3
KEY = ["depth", "p1", "p2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Turns:
    """Turns in order: rows (conv_id, part, at, t1, t2, n_words), at being their order in a part; and pieces (conv_id, part, first,
    n, offset), one for each part that holds turns of a conversation."""

    rows: DataFrame
    pieces: DataFrame

    def lengths(self) -> DataFrame:
        return self.pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))

    def placed(self, facts: DataFrame | None = None) -> DataFrame:
        """(conv_id, pos, t1, t2, n_words), pos from 1, and the columns of facts, which has a row a conversation. Joined by piece, so a
        conversation with very many turns is no hot key."""
        pieces = self.pieces if facts is None else self.pieces.join(facts, "conv_id")
        joined = self.rows.join(pieces.drop("n"), ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("offset") + 1)
        return joined.drop("part", "at", "first", "offset")


def ordered_turns(df: DataFrame) -> Turns:
    """Rows are range-sorted, so places are counted in each partition and offset by the counts of those before it."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text).filter("conv_id is not null")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = [F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(7), F.col("text"), F.col("role")).alias("t2")]
    words = F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")
    made = stored(rows.select("conv_id", F.monotonically_increasing_id().alias("at"), *hashes, words), "turns")
    made = made.withColumn("part", F.shiftright("at", 33))
    pieces = made.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return Turns(made, stored(pieces.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "pieces"))


def _roots(convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return convs.select("conv_id", *(zero.alias(c) for c in ("depth", "t1", "t2", "n_words")))


def as_they_are(turns: Turns) -> DataFrame:
    """(conv_id, depth, t1, t2, n_words), with a row of depth 0 for each conversation."""
    return turns.placed().withColumnRenamed("pos", "depth").unionByName(_roots(turns.lengths()))


def grafted(turns: Turns, base: Column, take: Column) -> DataFrame:
    """as_they_are(), but the first `take` turns of a conversation are replaced by those of its base.

    base: the other conversation's id; take: how many turns, at most MAX_GRAFT; both Columns over conv_id. A conversation that is its
    own base stays as it is; one whose base is not there only loses its turns.
    """
    plan = turns.lengths().withColumn("base", base).withColumn("take", F.when(F.col("conv_id") == F.col("base"), F.lit(0)).otherwise(take))
    have = turns.lengths().select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    borrowed = F.least(F.col("take"), F.coalesce("base_n", F.lit(0))).cast("long")
    plan = stored(plan.join(have, "base", "left").withColumn("borrowed", borrowed).select("conv_id", "base", "take", "borrowed"), "plan")
    placed = stored(turns.placed(plan.select("conv_id", "take", "borrowed")), "placed")
    own = placed.filter("pos > take").withColumn("depth", F.col("pos") - F.col("take") + F.col("borrowed"))
    firsts = placed.filter(F.col("pos") <= MAX_GRAFT).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "t1", "t2", "n_words")
    taken = firsts.join(plan.filter("borrowed > 0").select("conv_id", "base", "borrowed"), "base").filter("depth <= borrowed")
    names = ["conv_id", "depth", "t1", "t2", "n_words"]
    return own.select(*names).unionByName(taken.select(*names)).unionByName(_roots(plan))


@dataclass(frozen=True)
class Running:
    """A running value: what a row adds, "bit_xor", "max" or "sum", and how partial results {a} and {b} meet, as SQL."""

    adds: Column
    how: str
    meet: str

    def over(self, name: str, window: WindowSpec) -> Column:
        return getattr(F, self.how)(name).over(window)


def scanned(rows: DataFrame, keys: list[str], order: str, values: dict[str, Running], longest: int, backwards: bool = False) -> DataFrame:
    """rows with running values along `order` within the keys; no value of `order` is above `longest`.

    Segments of SEGMENT places are scanned by themselves, then their totals over segments; where no place is beyond the first
    segment, there is nothing to carry.
    """
    by = F.col(order).desc() if backwards else F.col(order)
    rows = rows.withColumn("_seg", F.floor(F.col(order) / SEGMENT)).withColumns({f"_in_{k}": v.adds for k, v in values.items()})
    near = Window.partitionBy(*keys, "_seg").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({k: v.over(f"_in_{k}", near) for k, v in values.items()}).drop(*(f"_in_{k}" for k in values))
    if longest < SEGMENT:
        return local.drop("_seg")
    totals = rows.groupBy(*keys, "_seg").agg(*(getattr(F, v.how)(f"_in_{k}").alias(f"_of_{k}") for k, v in values.items()))
    far = Window.partitionBy(*keys).orderBy(F.col("_seg").desc() if backwards else F.col("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_seg", *(v.over(f"_of_{k}", far).alias(f"_off_{k}") for k, v in values.items()))
    joined = local.join(offsets, [*keys, "_seg"], "left")
    met = {}
    for k, v in values.items():
        off = F.col(f"_off_{k}")
        met[k] = F.when(off.isNull(), F.col(k)).when(F.col(k).isNull(), off).otherwise(F.expr(v.meet.format(a=f"_off_{k}", b=k)))
    return joined.withColumns(met).drop("_seg", *(f"_off_{k}" for k in values))


def _xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """rows of as_they_are() or grafted() with (p1, p2), the name of the prefix, and (q1, q2), that of its parent."""
    placed = {f"x{k}": F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64("depth", f"t{k}", f"t{3 - k}")) for k in (1, 2)}
    rows = rows.withColumns(placed).drop("t1", "t2")
    made = scanned(rows, ["conv_id"], "depth", {f"p{k}": Running(F.col(f"x{k}"), "bit_xor", "{a} ^ {b}") for k in (1, 2)}, longest)
    return made.withColumn("q1", _xor("p1", "x1")).withColumn("q2", _xor("p2", "x2")).drop("x1", "x2")


def nodes_of(rows: DataFrame, total: int) -> DataFrame:
    """One row a node: its key, conv_id (smallest member), n_convs, n_words, n_children, parent_conv_id, light."""
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nodes = stored(nodes, "nodes")
    best = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("less")))
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    kids = kids.agg(F.count(F.lit(1)).alias("n_children"), best.alias("best")).withColumn("heavy", F.bitwise_not("best.less")).drop("best")
    full = stored(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "parents")
    parents = full.filter("n_children > 0").select(F.col("depth").alias("up"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n_convs", F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    children = full.filter("depth > 0").withColumn("up", F.col("depth") - 1).withColumnRenamed("n_convs", "members")
    children = hot_lookup(children, parents, ["up", "q1", "q2"], "n_convs", total, F.col("conv_id")).drop("n_convs").withColumnRenamed("members", "n_convs")
    children = children.withColumn("light", F.col("conv_id") != F.col("chosen"))
    roots = full.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "light": F.lit(False)})
    names = [*KEY, "conv_id", "n_convs", "n_words", "n_children", "parent_conv_id", "light"]
    return stored(children.select(*names).unionByName(roots.select(*names)), "trie")


def heavy_paths(rows: DataFrame, nodes: DataFrame, total: int, longest: int) -> tuple[DataFrame, int]:
    """nodes with their heavy path, written by level: (top_conv, top_depth), and level, the number of light edges above; and the
    greatest level."""
    facts = hot_lookup(rows.select("conv_id", *KEY), nodes.withColumnRenamed("conv_id", "rep"), KEY, "n_convs", total, F.col("conv_id"))
    edge = F.when(F.col("light") | (F.col("depth") == 0), F.struct("depth", "rep"))
    values = {"top": Running(edge, "max", "greatest({a}, {b})"), "level": Running(F.col("light").cast("int"), "sum", "{a} + {b}")}
    made = scanned(facts, ["conv_id"], "depth", values, longest).filter("conv_id = rep")
    made = made.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_words", "n_children", "light", F.col("top.rep").alias("top_conv"), F.col("top.depth").alias("top_depth"), F.col("level").cast("int").alias("level"))
    made = stored(made, "paths")
    return made, made.agg(F.max("level")).first()[0] or 0


def subtree_sums(paths: DataFrame, levels: int, longest: int) -> DataFrame:
    """paths with n_leaves and saved_tokens, summed over each node's subtree: one round a level of light edges."""
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words")}
    names = [*(c for c in paths.columns if c != "light"), *own]
    out, hanging = None, None
    for level in range(levels, -1, -1):
        rows = paths.filter(F.col("level") == level).withColumns(own)
        if hanging is not None:
            rows = rows.join(hanging, ["conv_id", "depth"], "left").withColumns({k: F.col(k) + F.coalesce(f"more_{k}", F.lit(0)) for k in own})
        values = {f"s_{k}": Running(F.col(k), "sum", "{a} + {b}") for k in own}
        rows = scanned(rows, ["top_conv", "top_depth"], "depth", values, longest, backwards=True).withColumns({k: F.col(f"s_{k}") for k in own})
        rows = stored(rows.select(*names), f"level{level}")
        tops = rows.filter(F.col("depth") == F.col("top_depth")).filter("depth > 0")
        hanging = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*(F.sum(k).alias(f"more_{k}") for k in own))
        out = rows if out is None else out.unionByName(rows)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members (conv_id, depth, member), sorted, as pieces (conv_id, depth, first, ids) of PIECE_BYTES at most."""
    made: list[tuple] = []
    key, ids, size = None, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal made
        columns, made = list(zip(*made, strict=True)), []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "depth", "first", "ids"])

    for batch in batches:
        for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = str(member)
            if (conv, depth) != key or size + len(text) + 1 > PIECE_BYTES:
                if ids:
                    made.append((*key, int(ids[0]), ",".join(ids)))
                key, ids, size = (conv, depth), [], 0
            ids.append(text)
            size += len(text) + 1
        if len(made) >= 1000:
            yield flush()
    if ids:
        made.append((*key, int(ids[0]), ",".join(ids)))
    if made:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of a node, one after another, to (conv_id, depth, ends_sha256)."""
    key, running, out = None, None, []

    def flush() -> pa.RecordBatch:
        nonlocal out
        columns, out = list(zip(*out, strict=True)), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        for conv, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, depth) != key:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = (conv, depth), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(out) >= 1000:
            yield flush()
    if key is not None:
        out.append((*key, running.hexdigest()))
    if out:
        yield flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which conversations end; ends: (conv_id, depth, member)."""
    order = ["conv_id", "depth", "member"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "conv_id long, depth long, first long, ids string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of conversations given as as_they_are() or grafted() give them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the heavy path:
    top_conv, top_depth, level.
    """
    conversations = stored(conversations, "conversations")
    total, longest = conversations.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    rows = stored(prefixes(conversations, longest), "prefixes")
    nodes = nodes_of(rows, total)
    paths, levels = heavy_paths(rows, nodes, total, longest)
    summed = subtree_sums(paths, levels, longest)
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("last")).select("conv_id", "last.*")
    ends = hot_lookup(last, nodes.select(*KEY, "n_convs", F.col("conv_id").alias("rep")), KEY, "n_convs", total, F.col("conv_id"))
    digests = end_digests(ends.select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    out = summed.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top_conv", "top_depth", "level")

