"""Folder intervals and the segmented index against plain Python."""

import random

import pytest

from tarn.operators import folders, mounts, search
from tarn.sources import scratch


@pytest.fixture(scope="module")
def tree(spark):
    rnd = random.Random(4)
    names = ["a", "a-b", "a b", "b", "B", "é", "a.md", "~"]
    paths = {"/".join(rnd.choice(names) for _ in range(rnd.randint(1, 6))) for _ in range(300)}
    rows = [(i, p) for i, p in enumerate(sorted(paths))] + [(900, "a"), (901, "a/b")]  # paths that two nodes have
    return rows, spark.createDataFrame(rows, "id long, path string").repartition(3)


def is_below(path, folder):
    return path.startswith(folder + "/")


def test_intervals(spark, tree):
    rows, df = tree
    placed = {r["id"]: r for r in folders.intervals(df).collect()}
    order = sorted(rows, key=lambda r: (r[1].split("/"), r[0]))
    assert [placed[i]["first"] for i, _ in order] == list(range(1, len(rows) + 1))
    for i, p in rows:
        inside = {j for j, q in rows if is_below(q, p)}
        span = {j for j, r in placed.items() if placed[i]["first"] < r["first"] <= placed[i]["last"]}
        assert inside <= span and all(q == p or j in inside for j, q in rows if j in span)
    sizes = {r["id"]: r["below"] for r in folders.subtree_sizes(folders.intervals(df)).collect()}
    assert sizes[max(i for i, p in rows if p == "b")] == sum(is_below(q, "b") for _, q in rows)


def test_below_and_under(spark, tree):
    rows, df = tree
    placed = scratch.store(folders.intervals(df))
    marks = {i for i, _ in rows if i % 7 == 0}
    got = {r["id"]: r["inside"] for r in folders.below(placed, placed["id"] % 7 == 0).collect()}
    for i, p in rows:
        wanted = any(is_below(p, q) for j, q in rows if j in marks)
        assert got[i] == wanted or [q for j, q in rows if j != i].count(p), p
    asked = placed.filter("path in ('a', 'b/a') and id < 900").select(placed["path"].alias("folder"), "first", "last")
    found = {(r["folder"], r["id"]) for r in folders.under(placed, asked).collect()}
    assert {(f, i) for f in ("a", "b/a") for i, p in rows if is_below(p, f)} <= found
    assert folders.intervals(df.limit(0)).count() == 0 and folders.below(placed.limit(0), placed["id"] > 0).count() == 0


def test_segments_equal_a_fresh_index(spark, tmp_path):
    rnd, words = random.Random(8), "one two three four five six".split()
    text = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 12)))
    index, held = search.SegmentedIndex(spark, f"file://{tmp_path}/index", parts=3), {}
    assert index.ranked(["one"]).count() == 0
    for step in range(5):
        changed = {i: (None if step and rnd.random() < 0.3 else text()) for i in rnd.sample(range(40), 15)}
        index.apply(spark.createDataFrame([(i, t, t is None) for i, t in changed.items()], "id long, text string, gone boolean"))
        held = {i: t for i, t in (held | changed).items() if t is not None}
        if step in (2, 3):
            index.merge()
        fresh = search.bm25(spark.createDataFrame(list(held.items()), "id long, text string"), ["one", "four"])
        assert [tuple(r) for r in index.ranked(["four", "one", "one"]).collect()] == [tuple(r) for r in fresh.collect()]
    assert len(index.segments()) == 2
    index.apply(spark.createDataFrame([(i, None, True) for i in held], "id long, text string, gone boolean"))
    assert index.documents().count() == 0 and index.ranked(["one"]).count() == 0


def test_calls_come_in_pieces(spark):
    reads = [(s, s % 3, 100 - s) for s in range(50)]
    got = sorted((r["workspace"], r["place"], r["piece"], r["ids"]) for r in mounts.calls(spark.createDataFrame(reads, "seq long, workspace long, id long"), 4).collect())
    wanted = []
    for w in range(3):
        ids = [i for s, x, i in reads if x == w]
        wanted += [(w, w, k // 4, ids[k : k + 4]) for k in range(0, len(ids), 4)]
    assert got == wanted
