"""Work is dealt to tasks by rows, whatever the size of a table in bytes."""

import pandas as pd
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.operators import artifact, graph, reading, search
from tarn.plans import catalogue
from tarn.streaming import claims


def most_in_a_task(rows) -> int:
    return rows.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def test_path_targets_are_no_hot_key(spark):
    """F13 F14: targets without an id do not meet under one key."""
    targets = spark.range(1000).select(F.col("id").alias("target"), F.when(F.col("id") >= 0, "a").alias("mount"), F.when(F.col("id") < 0, F.col("id")).alias("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"))
    mounts = spark.createDataFrame([("a", "ours", "present")], "mount string, identity string, state string")
    nodes = spark.createDataFrame([("a", 1, "p1", "note"), ("a", 9, "p1", "folder"), ("a", 2, "p2", "note"), ("a", 3, "p3", "folder")], "mount string, id long, path string, kind string")
    files = spark.createDataFrame([("a", 2, "gone")], "mount string, id long, fact string")
    parks = spark.createDataFrame([("a", 5, "p5")], "mount string, id long, path string")
    ledger = nodes.select("mount", "id")
    made = reading.locate(targets, mounts, nodes, parks, ledger, files)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert most_in_a_task(made) < 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = {r.target: (r.id, r.outcome) for r in made.filter("target < 7").collect()}
    assert found == {0: (None, "not_held"), 1: (1, "hit"), 2: (None, "gone"), 3: (None, "folder"), 4: (None, "not_held"), 5: (None, "parked"), 6: (None, "not_held")}


def test_names_are_encoded_by_several_tasks(spark, sf_dir):
    """F17 F20: a table that is small in bytes is not one task's work."""
    for name in ("classify_windows", "win_paths"):
        made = catalogue.queries()[name](spark, sf_dir)
        assert most_in_a_task(made) < made.count()


def test_decoded_names_keep_every_character(spark):
    rows = [("a%3Cb",), ("%",), ("%4",), ("x%2E",), ("%43ON",), ("a\x01%3C",), ("",), (None,), ("%25é%7C",)]
    made = spark.createDataFrame(rows, "p string").select("p", rules.decode_win_segment(F.col("p")).alias("d")).collect()
    assert {r.p: r.d for r in made} == {"a%3Cb": "a<b", "%": "%", "%4": "%4", "x%2E": "x.", "%43ON": "CON", "a\x01%3C": "a\x01%3C", "": "", None: None, "%25é%7C": "%é|"}


def test_one_call_claims_for_many_ids():
    """the state is held by bucket, so one call takes in all of its ids."""

    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    state = claims.Highest()
    state.held = Held()
    batch = lambda *rows: iter([pd.DataFrame(list(rows[:2]), columns=["id", "rev"]), pd.DataFrame(list(rows[2:]), columns=["id", "rev"])])
    taken = lambda *rows: [tuple(r) for made in state.handleInputRows((0,), batch(*rows), None) for r in made.to_numpy().tolist()]
    assert taken((7, 3), (2, 5), (7, 9), (-4, -1)) == [(-4, -1), (2, 5), (7, 9)]
    assert taken((7, 9), (2, 4), (-4, -2)) == []
    assert taken((3, 1), (7, 10), (99, 0), (2, 5)) == [(3, 1), (7, 10), (99, 0)]
    assert taken((3, 0), (99, 1), (-9, 8)) == [(-9, 8), (99, 1)]


def test_words_move_once(spark):
    """words are counted in the task of their text; counts are not shuffled."""
    docs = spark.createDataFrame([(1, "A b, a"), (2, ""), (3, None), (4, "b")], "id long, text string")
    rows = search.posting_rows(docs)
    assert sorted(map(tuple, rows.collect())) == [(1, 3, "a", 2), (1, 3, "b", 1), (4, 1, "b", 1)]
    plan = rows._jdf.queryExecution().executedPlan().initialPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_segments_move_no_words(spark, tmp_path):
    """words are counted and sorted where their text is read: a list a word and task, not a row a word and text."""
    docs = spark.range(0, 60, 1, 2).select("id", F.when(F.col("id") % 4 == 1, None).when(F.col("id") % 4 == 2, " ,; ").otherwise("Sole, ÉTÉ été x2").alias("text"), F.lit(False).alias("gone"))
    index = search.SegmentedIndex(spark, f"file://{tmp_path}/index", parts=3)
    index.apply(docs)
    for number in (1, 2):
        assert spark.read.parquet(f"file://{tmp_path}/index/segment-{number}/postings").count() <= 2 * 3
        found = index._postings(["été", "sole", "none"])
        assert sorted((r.term, r.id, r.tf) for r in found.collect()) == sorted(x for i in range(60) if i % 4 in (0, 3) for x in (("sole", i, 1), ("été", i, 2)))
        assert {r.id: r.len for r in index.documents().collect()} == {i: 4 if i % 4 in (0, 3) else 0 for i in range(60)}
        index.merge()


def test_few_words_move_to_their_frequencies(spark, monkeypatch):
    """F16: of the words in most notes no more moves than may be among a note's first; those and all others are ranked alike."""
    texts = {i: " ".join(f"w{(i * j) % 23}" for j in range(i % 40)) + f" only{i}" for i in range(60)} | {60: "", 61: None, 62: " .,", 63: "Éa éA 9"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    moved, write = [], artifact.store
    monkeypatch.setattr(artifact, "store", lambda df: moved.append(write(df)) or moved[-1])
    rows = lambda df: sorted(map(tuple, df.collect()))
    wanted = {}
    for hot in (1000, 10, 1):
        monkeypatch.setattr(artifact, "HOT_TERMS", hot)
        wanted[hot] = rows(artifact.distinctive_terms(docs, 2))
    assert wanted[1000] == wanted[10] == wanted[1] and {r[0] for r in wanted[1]} == {*range(60), 63}
    assert rows(artifact.distinctive_terms(docs.filter("id > 59 and id < 63"))) == []
    every = moved[8].count()  # three tables a call, the last of them the words that move; one word is hot in the third call
    assert moved[2].count() < every / 2 and moved[2].count() <= moved[5].count() < every


def test_graph_reads_are_dealt_by_rows(spark, monkeypatch):
    """F21 F22: more rows make more tasks, whatever the number of shuffle partitions; the results are those of the small form."""
    monkeypatch.setattr(graph, "ROWS_A_TASK", 20)
    nodes = spark.range(40).select("id", (F.col("id") % 3 != 0).alias("live"))
    files = spark.range(100, 105).select("id", (F.col("id") != 102).alias("live"))
    k = F.col("id")
    edges = spark.range(400).select((k % 41).alias("src"), F.when(k % 4 == 0, "embed").otherwise("wikilink").alias("kind"), F.when(k % 4 == 1, k * 7 % 45).when(k % 4 == 3, k % 41).alias("dst"), F.when(k % 4 == 0, k % 6 + 100).alias("att"), F.when(k % 4 == 2, "x").otherwise("").alias("ref"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    both = lambda *made: {tuple(r) for df in made for r in df.collect()}
    itself = {(i, i) for i in (*range(40), *range(100, 105))}
    parts = graph.forward_links(edges, nodes), graph.backlinks(edges, nodes), graph.attachment_embeds(edges, nodes, files), graph.unresolved_refs(edges)
    made = graph.exclusion_set(edges, nodes, files)
    assert rows(made) == sorted(itself | both(*parts[:3], graph.attachment_embedders(edges, nodes)))
    count = lambda df, i: df.filter(F.col("subject") == i).count()
    counts = graph.graph_summary(edges, nodes, files)
    held = {r[0]: tuple(r[1:]) for r in counts.collect()}
    assert set(held) == {i for i in range(40) if i % 3} and all(held[i] == tuple(count(df, i) for df in parts) for i in (1, 7, 25))
    assert made.rdd.getNumPartitions() == 20 and counts.rdd.getNumPartitions() == 20
