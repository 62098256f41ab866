"""Held lists that many subjects share, as their factors: the rows of each list once, and which list and which bar a subject has. A bar keeps
rows of the same bar from a subject. No pair of a subject and a row is stored; ranks are counted from the lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import related
from tarn.operators.graph import global_rank
from tarn.sources.scratch import store

#: Places of a list that are counted together.
STEP = 4096


def numbered(rows: DataFrame, live: DataFrame) -> DataFrame:
    """(id, list, bar, n) of rows(id, list, position, bar): n is the place of a live row in its list; rows without a list are left out."""
    alive = rows.filter("list is not null").join(live.select("id"), "id", "left_semi")
    every = store(global_rank(alive, [F.col("list"), F.col("position"), F.col("id")], "over_all"))
    first = every.groupBy("list").agg(F.min("over_all").alias("first"))
    return store(every.join(first, "list").select("id", "list", "bar", (F.col("over_all") - F.col("first") + 1).alias("n")))


def barred_upto(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked(list, bar, n), each once, with `barred`: how many of numbered rows have this list and bar, and no greater n. Counts go by
    STEP places, so no list and no bar is one task's work."""
    key, kept = ["list", "bar", "step"], Window.unboundedPreceding
    marked = lambda df, held: df.select("list", "bar", F.col("n").cast("long").alias("n"), F.lit(held).alias("held"))
    both = marked(rows, 1).unionByName(marked(asked, 0)).withColumn("step", F.floor(F.col("n") / STEP))
    steps = both.groupBy(*key).agg(F.sum("held").alias("held"))
    before = steps.select(*key, F.coalesce(F.sum("held").over(Window.partitionBy("list", "bar").orderBy("step").rowsBetween(kept, -1)), F.lit(0)).alias("before"))
    within = both.withColumn("within", F.sum("held").over(Window.partitionBy(*key).orderBy("n", F.desc("held")).rowsBetween(kept, Window.currentRow)))
    return within.filter("held = 0").join(before, key).select("list", "bar", "n", (F.col("before") + F.col("within")).alias("barred"))


def first_of(subjects: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """(subject, id): the first `depth` rows of each subject's list that its bar does not keep from it; subjects(subject, list, bar). Of a
    list no more places are looked at than `depth` and those that the bar takes."""
    asked = subjects.select("list", "bar").filter("list is not null").distinct()
    taken = rows.groupBy("list", "bar").agg(F.count(F.lit(1)).alias("taken"))
    upto = asked.join(taken, ["list", "bar"], "left").join(rows.groupBy("list").agg(F.max("n").alias("size")), "list")
    places = store(upto.select("list", "bar", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.coalesce("taken", F.lit(0)) + depth, "size"))).alias("n")))
    open_ = barred_upto(places, rows).filter(F.col("n") - F.col("barred") <= depth)
    found = open_.join(rows.select("list", "n", "id", F.col("bar").alias("own")), ["list", "n"]).filter("not own <=> bar").select("list", "bar", "id")
    return subjects.join(found, ["list", "bar"]).select("subject", "id")


def ranks(pairs: DataFrame, subjects: DataFrame, rows: DataFrame) -> DataFrame:
    """(subject, id, rank) of those pairs(subject, id) in which the row stands in the subject's list and is not barred: related.held_arm() for
    these pairs."""
    own = rows.select("id", "list", "n", F.col("bar").alias("own"))
    met = store(pairs.join(subjects, "subject").join(own, ["id", "list"]).filter("not own <=> bar").select("subject", "id", "list", "bar", "n"))
    counted = barred_upto(met.select("list", "bar", "n").distinct(), rows)
    return met.join(counted, ["list", "bar", "n"]).select("subject", "id", (F.col("n") - F.col("barred")).cast("int").alias("rank"))


def fuse(graph: tuple[DataFrame, DataFrame], lexical: DataFrame, tags: tuple[DataFrame, DataFrame], words: DataFrame, paths: DataFrame, limit: int = 10) -> DataFrame:
    """related.fuse() of two arms given as (subjects, numbered rows), where every row has a path.

    A list with `limit` open rows or more gives the last of the ranking 1 / (RRF_K + limit) at least. A row beyond RRF_K + 2 * limit in
    both lists has less, and has no place unless the lexical arm holds it. So the first rows of both lists and the lexical arm are all that
    can have one; their ranks are exact in every arm.
    """
    depth = related.RRF_K + 2 * min(max(limit, 1), 25)
    tried = store(first_of(*graph, depth).union(first_of(*tags, depth)).union(lexical.select("subject", "id")).distinct())
    return related.fuse(ranks(tried, *graph), lexical, ranks(tried, *tags), words, paths, limit)


#: Subjects and rows of a list at most that a task puts together.
SUBJECTS, ROWS = 512, 2048


def reasons(graph: tuple[DataFrame, DataFrame], lexical: DataFrame, tags: tuple[DataFrame, DataFrame], terms: DataFrame) -> DataFrame:
    """(subject, id, rank, tagged, shared_terms): the whole arm by graph, as related.held_arm() gives it, with what related.why() says of each
    row: whether the arm by tag has it, and three shared terms at most where the arm lexical(subject, id) has it; terms(id, term, weight).

    Both arms are (subjects, numbered rows); a row has one tag list at most. Blocks of a list's subjects meet blocks of its rows, and the pairs
    leave their tasks: none is joined or shuffled. Counts of what bars take before a block come with its subjects.
    """
    (subjects, rows), (by_tag, tag_rows), key = graph, tags, ["list", "r", "s"]
    subjects = subjects.filter("list is not null").join(by_tag.select("subject", F.col("list").cast("string").alias("tag")), "subject", "left")
    rows = rows.join(tag_rows.select("id", F.col("list").cast("string").alias("tag")), "id", "left").withColumn("r", F.floor((F.col("n") - 1) / ROWS))
    both = lexical.select("subject", "id").join(subjects.select("subject", "list"), "subject").join(rows.select("id", "list", "r"), ["id", "list"])
    both = store(both.select("subject", "id", "r"))
    best = related.top_shared_terms(terms, both).groupBy("subject", "id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    hits = both.join(best, ["subject", "id"]).groupBy("subject", "r").agg(F.collect_list(F.struct("id", F.col("t.term").alias("terms"))).alias("hits"))
    size = rows.groupBy("list").agg(F.max("r").alias("last"))
    parts = subjects.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SUBJECTS).alias("parts"))
    dealt = subjects.join(size, "list").join(parts, "list").withColumn("s", F.pmod(F.xxhash64("subject"), F.col("parts")))
    dealt = store(dealt.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumn("n", F.col("r") * ROWS).drop("last", "parts"))
    before = barred_upto(dealt.select("list", "bar", "n").distinct(), rows)
    left = dealt.join(before, ["list", "bar", "n"], "left").join(hits, ["subject", "r"], "left")  # a subject may have no bar
    left = left.select(*key, "subject", F.col("bar").cast("long").alias("bar"), "tag", F.coalesce("barred", F.lit(0)).alias("barred"), F.col("hits.id").alias("hit_ids"), F.col("hits.terms").alias("hit_terms"))
    right = rows.join(parts, "list").select("list", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("s"), "id", F.col("n"), F.col("bar").cast("long").alias("bar"), "tag")
    kind = dict(terms.dtypes)["term"]
    wanted = pa.schema([("subject", pa.int64()), ("id", pa.int64()), ("rank", pa.int32()), ("tagged", pa.bool_()), ("shared_terms", pa.list_({"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.string())))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return wanted.empty_table()
        right = right.sort_by("n")
        own, theirs = related.coded_alike(left.column("bar"), right.column("bar"))
        tag, tags = related.coded_alike(left.column("tag"), right.column("tag"))
        open_ = own[:, None] != theirs[None, :]
        s, r = np.nonzero(open_)
        ids, place = right.column("id").to_numpy(), right.column("n").to_numpy()
        rank = place[r] - left.column("barred").to_numpy()[s] - np.cumsum(~open_, axis=1)[s, r]
        row, lengths, found = {int(x): k for k, x in enumerate(ids)}, np.zeros(len(s), np.int64), []
        for k in np.flatnonzero(pc.is_valid(left.column("hit_ids")).to_numpy()).tolist():
            for i, t in zip(left.column("hit_ids")[k].as_py(), left.column("hit_terms")[k].as_py(), strict=True):
                if open_[k, row[i]]:
                    found.append((k * len(ids) + row[i], t))
        found.sort(key=lambda x: x[0])
        if found:
            lengths[np.searchsorted(s * len(ids) + r, [x[0] for x in found])] = [len(x[1]) for x in found]
        values = pa.array([t for _, x in found for t in x], wanted.field("shared_terms").type.value_type)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, values, mask=pa.array(lengths == 0))
        subject = left.column("subject").to_numpy()
        return pa.table([pa.array(subject[s]), pa.array(ids[r]), pa.array(rank.astype(np.int32)), pa.array(tag[s] == tags[r]), lists], schema=wanted)

    groups = size.join(parts, "list").agg(F.coalesce(F.sum((F.col("last") + 1) * F.col("parts")), F.lit(1))).first()[0]
    dealt_out = lambda df: df.repartition(min(groups, related.MOST_TASKS), *key).groupBy(*key)  # noqa: E731  by work, not by bytes: few make many pairs
    return dealt_out(left).cogroup(dealt_out(right)).applyInArrow(run, f"subject long, id long, rank int, tagged boolean, shared_terms array<{kind}>")
