"""Prefix trie, hard negatives and language identification against brute force and held-out accuracy, with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import hard_negatives, language_id, prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string, depth int, p1 string, part string, _seg long"


def plain_trie(rows, graft):
    """Nodes by the contract, with lists: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, digest)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        base, h = graft(c)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, some in members.items():
        worth = (len(some) - 1) * (words(node[-1][1]) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += worth
    digest = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node)).encode()).hexdigest()
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(n)) for n, m in members.items()}


def by_contract(c):
    return c - int(math.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4


def spark_trie(df):
    take = F.crc32(F.col("conv_id").cast("string")) % 4
    return prefix_trie.trie(prefix_trie.grafted(prefix_trie.ordered_turns(df), F.col("conv_id") - F.col("conv_id") % 20, take))


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("segment", [1024, 2])
def test_trie_by_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 5]), rng.choice(["user", None, ""]), rng.choice(["a b", "a", None, "", "c\x0bd  e"])) for c in (-21, -20, -3, 0, 1, 2, 3, 20, 21, 22, 24, 47) for _ in range(rng.randint(1, 6))]
    rows += [(100 + k, t, "user", "same text") for k in range(30) for t in range(7)] + [(41, t, "user", f"long {t}") for t in range(40)] + [(None, 1, "user", "x"), (21, 0, "u", "v"), (21, 0, "u", "v")]
    df = spark.createDataFrame([(*r, 1, "p", "q", 5) for r in rows], TURNS)
    made = spark_trie(df).cache()
    assert {tuple(r) for r in made.select(*NAMES).collect()} == plain_trie(rows, by_contract)
    assert made.agg(F.max("level")).first()[0] <= math.log2(43) and made.filter("depth = 0").count() == 1
    tops = made.filter("level > 0").groupBy("top_conv", "top_depth").agg(F.min("depth").alias("d"), F.max("depth").alias("e"), F.count("*").alias("n")).filter("d <> top_depth or e - d + 1 <> n")
    assert tops.count() == 0
    assert spark_trie(df.limit(0)).count() == 0


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "c")]
    made = prefix_trie.trie(prefix_trie.as_they_are(prefix_trie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert {tuple(r) for r in made.select(*NAMES).collect()} == plain_trie(rows, lambda c: (c, 0))


def test_end_lists_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 16)
    some = [(1, 2, k) for k in range(-5, 200)] + [(7, 2, 7)]
    batches = spark.createDataFrame(some, "conv_id long, depth long, member long").orderBy("conv_id", "depth", "member").toArrow().to_batches()
    pieces = list(prefix_trie._pieces(iter(batches)))
    assert sum(p.num_rows for p in pieces) > 20
    made = {tuple(r.values()) for b in prefix_trie._digests(iter(pieces)) for r in b.to_pylist()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert made == {(1, 2, digest(range(-5, 200))), (7, 2, digest([7]))}


VECTORS = "vec_id long, embedding array<float>, label int, id string, key int, codes int, place int"


def plain_mine(rows, k=5, m=3):
    """By the contract, with Python integers, scores clipped to 64 bits."""
    some = {}
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            some[vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    some, out = list(some), []
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(1 << 63)), (1 << 63) - 1)
    for a in some:
        if a[0] % 50:
            continue
        scored = sorted((-dot(a[2], r[2]), r[0], r[1]) for r in some)
        for p in [s for s in scored if s[2] == a[1] and s[1] != a[0]][:k]:
            rest = [s for s in scored if s[2] != a[1] and -50 * p[0] <= -100 * s[0] <= -95 * p[0]][:m]
            out += [(a[0], p[1], i + 1, s[1], -p[0], -s[0]) for i, s in enumerate(rest)]
    return sorted(out)


@pytest.mark.parametrize("slot", [8192, 60])
@pytest.mark.parametrize("scale", [1.0, 3e4, 1e7])
def test_hard_negatives_by_brute_force(spark, monkeypatch, slot, scale):
    monkeypatch.setattr(hard_negatives, "SLOT_ROWS", slot)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    rng = np.random.default_rng(int(scale) + slot)
    centres = rng.normal(size=(4, 7))
    rows = [(int(i), [float(np.float32(x)) for x in scale * (centres[i % 4] + rng.normal(size=7))], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(450, rows[50][1], 1), (451, rows[50][1], 2), (452, rows[50][1], 1), (500, [], 1), (501, [1.0, 2.0], 0), rows[100], rows[100]]
    rows += [(None, [1.0] * 7, 1), (550, None, 1), (600, [1.0] * 7, None), (650, [None] + [1.0] * 6, 1), (651, [float("nan")] * 7, 1), (652, [float("inf")] * 7, 1), (700, [0.0] * 7, 5), (701, [0.0] * 7, 5)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = hard_negatives.usable(df, "vec_id", label, "embedding")
    made = hard_negatives.mine(usable, F.col("id") % 50 == 0)
    assert sorted(map(tuple, made.collect())) == plain_mine(rows)
    if slot == 60:
        assert hard_negatives.mine(usable.limit(0), F.col("id") % 50 == 0).count() == 0
        assert hard_negatives.mine(usable, F.lit(False)).count() == 0


def test_bounds_hold_and_prune():
    """Bounds enclose every score; even of vectors without any structure fewer than half of the rows may enter a result, and of vectors in
    groups few do."""
    rng = np.random.default_rng(3)
    for spread, share in ((1.0, 0.5), (0.5, 0.2)):
        v = spread * rng.normal(0, 0.125, (3000, 64)) + np.sqrt(1 - spread**2) * rng.normal(0, 0.125, (30, 64))[np.arange(3000) % 30]
        check_bounds(np.floor(256 * v).astype(np.int64), share)


def check_bounds(v, share):
    import pandas as pd

    cuts = np.quantile(v, [i / 16 for i in range(1, 16)], axis=0).astype(np.int64).T
    low = np.column_stack([np.minimum(0, v.min(0)), cuts])
    marks = hard_negatives.Marks(low, np.column_stack([np.maximum(cuts - 1, low[:, :1]), v.max(0)]))
    rows = pd.DataFrame({"id": range(3000), "label": 0, "key": range(3000), "codes": [c.tobytes() for c in marks.codes(v)], "exact": [x.astype(marks.kind).tobytes() for x in v]})
    slot, kept = hard_negatives.Slot(rows[:20], rows, marks), 0
    for i, lower, upper in slot.bounds():
        scores = v @ v[i]
        assert (lower <= scores).all() and (scores <= upper).all()
        kept += (upper >= hard_negatives._kth(lower, 5)).sum()
    assert kept < share * 20 * 3000


@pytest.mark.parametrize("score", [0, 1, 7, 100, 12345, -3, 2**62])
def test_windows_are_exact(score):
    low, high = hard_negatives.window(score, (50, 95))
    assert 100 * (low - 1) < 50 * score <= 100 * low and 100 * high <= 95 * score < 100 * (high + 1)


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").withColumns({"key": F.lit("k"), "counts": F.lit(1), "lang_pred": F.lit("en")})
    made = {r["doc_id"]: r for r in queries.op13_language_id(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    rows = docs.collect()
    assert len(made) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {k for k, r in made.items() if r["held_out"]} and len(held) > 100
    assert sum(made[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in made.values())
    clashing = language_id.predict(docs, language_id.learn(docs.filter("doc_id % 2 = 0")))
    assert clashing.columns == ["doc_id", "lang_pred", "score"] and clashing.count() == len(rows)


def test_language_id_of_awkward_rows(spark):
    text = {"en": "the of and to in that with was for on this ", "de": "der die und das ein nicht mit zu von ist ", "fr": "le la les des une est que dans pour pas ", "zz": "qxq zzq xqz qqx zxz "}
    rows = [(i, text[lang] * (1 + i % 3), lang) for lang in text for i in range(12)] + [(90, None, "en"), (91, "", "en"), (92, "123 !? 456", "en"), (93, "der die und das", None), (None, "les des une", "fr"), (None, "les des une", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    model = language_id.learn(df)
    assert model.langs == ("de", "en", "fr", "zz") and model.pairs == ((0, 1),)
    asked = df.select("doc_id", "text", "score").union(spark.createDataFrame([(94, "the " * 700_000, "s"), (95, "Ω", "s"), (96, "1" * 10 + "É" * 3, "s")], "doc_id long, text string, score string"))
    made = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(asked, model).collect()), key=str)
    got = {k: x for k, x, _ in made}
    assert len(made) == len(rows) + 3 and all(0 <= s <= 1 for _, _, s in made)
    assert [got[k] for k in (90, 91, 92)] == ["und"] * 3 and got[93] == "de" and got[94] == "en" and got[95] in model.langs and got[None] == "fr"
    assert all(s == 0 for k, x, s in made if x == "und")
    one = language_id.learn(df.filter("lang = 'fr'"))
    assert {r["lang_pred"] for r in language_id.predict(asked, one).collect()} == {"fr", "und"}
    none = language_id.learn(df.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(asked, none).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_grams_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aÉé ßz1.Ω") for _ in range(rng.choice([0, 1, 2, 5, 300]))).encode() for _ in range(60)] + [b""]
    weights = np.random.default_rng(1).normal(size=(language_id.DIMS, 3)).astype(np.float32)
    whole, sums = language_id.counted(texts), language_id.summed(texts, weights)
    assert np.allclose(sums[:, :-1], whole @ weights, atol=1e-2) and (sums[:, -1] == whole.sum(1)).all()
    alone = np.concatenate([language_id.counted([t]) for t in texts])
    assert (alone == whole).all()
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert (language_id.counted(texts) == whole).all() and np.allclose(language_id.summed(texts, weights), sums, atol=1e-2)
