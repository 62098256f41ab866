"""Lists that many subjects share give the arms and rankings of the lists written out for each subject."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import lists, related


@pytest.fixture(scope="module")
def shared(spark):
    """Rows in three lists by graph and two by tag, some in none; bars of very different sizes; dead rows; subjects without a list."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 1, 2, 2, 2, None]), rnd.choice([5, 5, 6, None]), -i % 50, rnd.choice([7, 7, 7, 8, 9])) for i in range(400)]
    vectors = spark.createDataFrame(rows, "id long, g int, t int, position long, bar long").cache()
    live = vectors.filter("id % 7 <> 0").select("id")
    asked = vectors.filter("id % 9 = 0")
    arm = lambda name: (asked.select(F.col("id").alias("subject"), F.col(name).alias("list"), "bar"), vectors.select("id", F.col(name).alias("list"), "position", "bar"))
    excluded = asked.select(F.col("id").alias("subject"), "bar").join(vectors.select(F.col("id").alias("other"), "bar"), "bar").select("subject", "other")
    return vectors, live, asked, arm("g"), arm("t"), excluded


def written_out(arm, excluded, live):
    subjects, rows = arm
    held = subjects.select("subject", "list").join(rows.drop("bar"), "list").withColumn("position", F.struct("position", "id"))
    return related.held_arm(held, excluded, live)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_fused_lists_rank_like_lists_written_out(spark, shared, monkeypatch):
    """ranks come from the lists, and only rows that may have a place are ranked."""
    vectors, live, asked, by_graph, by_tag, excluded = shared
    monkeypatch.setattr(related, "RRF_K", 6)  # lists longer than what is looked at
    monkeypatch.setattr(lists, "STEP", 8)
    words = asked.select(F.col("id").alias("subject"), (F.col("id") * 3).alias("wc"))
    paths = vectors.select("id", F.concat(F.lit("v/"), F.col("id").cast("string")).alias("path"))
    lexical = asked.select(F.col("id").alias("subject"), F.explode(F.array(*(F.pmod(F.col("id") * k, F.lit(400)) for k in (3, 5, 11)))).alias("id")).distinct().join(live, "id", "left_semi")
    lexical = lexical.join(excluded.withColumnRenamed("other", "id"), ["subject", "id"], "left_anti").withColumn("rank", (F.col("id") % 19 + 1).cast("int"))
    numbered = [(subjects, lists.numbered(rows, live)) for subjects, rows in (by_graph, by_tag)]
    for limit in (4, 25):
        wanted = rows_of(related.fuse(written_out(by_graph, excluded, live), lexical, written_out(by_tag, excluded, live), words, paths, limit))
        assert rows_of(lists.fuse(numbered[0], lexical, numbered[1], words, paths, limit)) == wanted and wanted
    first = lists.first_of(*numbered[0], 8)
    assert rows_of(first) == rows_of(written_out(by_graph, excluded, live).filter("rank <= 8").select("subject", "id"))
    assert first.groupBy("subject").count().agg(F.max("count")).first()[0] == 8


@pytest.mark.parametrize("terms_a_row", [9, 2])
def test_bars_and_matrix_products_give_the_same_nearest(spark, shared, monkeypatch, terms_a_row):
    """F5 F6: rows of a subject's bar go before the cut like excluded pairs; a matrix product only says which cosines are to be summed. Equal rows,
    negative weights, subjects without a row."""
    vectors, live, asked, _, _, excluded = shared
    rnd = np.random.default_rng(4)
    made = rnd.standard_normal((400, 12)).astype(np.float32)
    made[200:260] = made[40:100]
    held = [(i, int(t), float(made[i, t])) for i in range(400) for t in rnd.choice(12, terms_a_row, replace=False) if i % 50 != 3]
    terms = spark.createDataFrame(held, "id long, term int, weight double").cache()
    subjects = asked.select("id").union(spark.createDataFrame([(9999,)], "id long"))
    bars = vectors.select("id", F.when(F.col("bar") != 9, F.col("bar")).alias("bar"))
    kept = excluded.join(bars.filter("bar is not null").select(F.col("id").alias("subject")), "subject", "left_semi")
    monkeypatch.setattr(related, "DENSE_TERMS", 0)
    wanted = rows_of(related.lexical_arm(terms, subjects, kept, live, 5))
    assert len(wanted) > 100
    for dense, rows, cells, size in ((0, 8192, 1 << 21, 32768), (256, 40, 300, 90)):
        for name, value in (("DENSE_TERMS", dense), ("TILE_ROWS", rows), ("CELLS", cells), ("ROW_BLOCK", size), ("CELL_GROUP", 3)):
            monkeypatch.setattr(related, name, value)
        assert rows_of(related.lexical_arm(terms, subjects, None, live, 5, bars=bars)) == wanted
    assert rows_of(related.lexical_arm(terms, subjects, kept, live, 5)) == wanted


def test_reasons_of_whole_lists(spark, shared, monkeypatch):
    """blocks of subjects and rows give what related.why() gives of arms written out, and no pair is joined or shuffled."""
    _, live, asked, by_graph, by_tag, excluded = shared
    for name, value in (("STEP", 8), ("SUBJECTS", 5), ("ROWS", 16)):
        monkeypatch.setattr(lists, name, value)
    terms = spark.range(400).select("id", F.explode(F.array(*(F.lit(t) for t in range(5)))).alias("term")).withColumn("weight", F.sin(F.col("id") * (F.col("term") + 1)))
    lexical = asked.select(F.col("id").alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(390), F.lit(6)).cast("array<long>")).alias("id")).join(live, "id", "left_semi")
    graph, tag = written_out(by_graph, excluded, live), written_out(by_tag, excluded, live)
    none = graph.select("subject", "id", F.lit(0).alias("shared"))
    wanted = related.why(graph, none, lexical, terms, tag.select("subject", "id", F.lit(True).alias("tags")))
    wanted = rows_of(wanted.select("subject", "id", "rank", F.col("shared_tags").isNotNull().alias("tagged"), F.concat_ws(",", "shared_terms").alias("t")))
    made = lists.reasons((by_graph[0], lists.numbered(by_graph[1], live)), lexical, (by_tag[0], lists.numbered(by_tag[1], live)), terms)
    after = made._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "Exchange" not in after and "Join" not in after
    assert rows_of(made.withColumn("shared_terms", F.concat_ws(",", "shared_terms"))) == wanted and len({r[4] for r in wanted}) > 9 and len({r[3] for r in wanted}) == 2
