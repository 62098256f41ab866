"""Scalar rules and small operators on hand-checked inputs."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.operators import changes, related, tasks
from tarn.operators.search import Filter


def values(spark, inputs, make):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").orderBy("i").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("spec", "low", "high", "error"),
    [("12-19", 12, 19, None), ("7-", 7, None, None), ("  8 ", 8, 8, None), ("+2 -  +6", 2, 6, None), ("0", None, None, "starts_at_zero"), ("3-0", None, None, "starts_at_zero"), ("21-20", None, None, "backwards"), ("  ", None, None, "not_a_range"), ("-", None, None, "not_a_range"), ("4-x", None, None, "not_a_range"), ("5-6-", None, None, "not_a_range"), ("1.5", None, None, "not_a_range"), ("0-x", None, None, "starts_at_zero"), ("x-0", None, None, "not_a_range"), ("\t7 -\n", 7, None, None), ("\u00a07\t-\u20039", 7, 9, None), ("-5", None, None, "not_a_range"), ("++5", None, None, "not_a_range"), ("5-", 5, None, None), ("0-", None, None, "starts_at_zero")],
)
def test_ranges(spark, spec, low, high, error):
    (got,) = values(spark, [spec], rules.parse_range)
    assert (got["from"], got["to"], got["error"]) == (low, high, error)


def test_names(spark):
    assert values(spark, ["plan.md", "PLAN.mD", "v1.2.md", "über.md", "x.md ", "md", ".md", "plan.mdx", "plan.", ""], rules.is_note_name) == [True] * 4 + [False] * 6
    assert values(spark, ["team-7", "0", "Team", "a_b", "", "y" * 64, "y" * 65, "end\n"], rules.valid_label) == [True, True, False, False, False, True, False, False]


def test_fold(spark):
    assert values(spark, ["É", "É", "ΟΔΟΣ", "Straße"], rules.fold_path) == ["é", "é", "οδοσ", "straße"]


@pytest.mark.parametrize(("server", "local"), [("CON.md", "%43ON.md"), ("a:b.md", "a%3Ab.md"), ("aux.tar", "%61ux.tar"), ("a<%b.md", "a%3C%25b.md"), ("trail.", "trail%2E"), ("sp .md", "sp .md"), ("LPT5.txt", "%4CPT5.txt"), ("COM¹.md", "%43OM¹.md"), ("a%b.md", "a%b.md")])
def test_windows_paths(spark, server, local):
    assert values(spark, [server], rules.encode_win_segment) == [local]
    assert values(spark, [local], rules.decode_win_segment) == [server]


def test_decode_only_exact_images(spark):
    assert values(spark, ["%20name.md", "%25.md", "%2ax.md", "CON%2Emd"], rules.decode_win_segment) == ["%20name.md", "%25.md", "%2ax.md", "CON%2Emd"]


def test_highlight(spark):
    (runs,) = values(spark, ["a<b>x</b></b><b>y"], rules.highlight_runs)
    assert [(r["text"], r["hit"]) for r in runs] == [("a", False), ("x", True), ("</b>", False), ("y", True)]


def test_exclusion_before_the_cut_liveness_after(spark):
    """Candidates in descending cosine by id; the third is excluded and makes room, the fifth is dead and does not."""
    rows = [(0, 0, 1.0)] + [x for i in range(1, 40) for x in ((i, 0, 1.0), (i, 1, i / 10))]
    terms = spark.createDataFrame(rows, "id long, term int, weight double")
    excluded = spark.createDataFrame([(0, 3), (0, 0)], "subject long, other long")
    live = spark.createDataFrame([(i,) for i in range(1, 40) if i != 5], "id long")
    got = [(r["id"], r["rank"]) for r in related.lexical_arm(terms, terms.filter("id = 0").select("id").distinct(), excluded, live).orderBy("rank").collect()]
    assert got == [(i, n) for n, i in enumerate([i for i in range(1, 22) if i not in (3, 5)], 1)]


def test_blocks_give_the_same_arm(spark, monkeypatch):
    rnd = random.Random(2)
    terms = spark.createDataFrame([(i, t, rnd.random()) for i in range(60) for t in rnd.sample(range(30), 5)], "id long, term int, weight double")
    subjects, none = terms.filter("id % 4 = 0").select("id").distinct(), spark.createDataFrame([], "subject long, other long")
    whole = sorted(map(tuple, related.lexical_arm(terms, subjects, none, terms.select("id").distinct(), 7).collect()))
    monkeypatch.setattr(related, "SUBJECT_BLOCK", 4)
    monkeypatch.setattr(related, "ROW_BLOCK", 9)
    assert sorted(map(tuple, related.lexical_arm(terms, subjects, none, terms.select("id").distinct(), 7).collect())) == whole


def test_the_term_index_gives_the_same_arm_from_fewer_pairs(spark):
    """Groups of rows with rare words of their own, and common words that all have with small weights; ties, excluded and dead rows."""
    rnd = random.Random(5)
    rows = [(i, f"g{i % 40}w{k}", rnd.choice([2.0, 3.0, 4.0])) for i in range(1200) for k in rnd.sample(range(12), 8)]
    rows += [(i, f"common{k}", rnd.choice([0.125, 0.25, -0.125])) for i in range(1200) for k in rnd.sample(range(30), 4)] + [(5000, "common1", 1.0), (5001, "zero", 0.0)]
    terms = spark.createDataFrame(rows, "id long, term string, weight double")
    subjects = spark.createDataFrame([(i,) for i in (*range(0, 1200, 40), 5000, 5001, 7000)], "id long")
    excluded = subjects.select(F.col("id").alias("subject"), F.col("id").alias("other")).union(spark.createDataFrame([(0, 40), (0, 80)], "subject long, other long"))
    live = terms.filter("id % 7 <> 0").select("id").distinct()
    pairs, dense, every = related.essential_pairs(terms, subjects, excluded)
    compared = pairs.count() + dense.count() * 1202
    assert 0 < compared < 0.3 * 32 * 1202 and pairs.join(excluded.withColumnRenamed("other", "id"), ["subject", "id"]).isEmpty()
    whole = sorted(map(tuple, related.lexical_arm(terms, subjects, excluded, live).collect()))
    assert sorted(map(tuple, related.pruned_arm(terms, subjects, excluded, live).collect())) == whole and len(whole) > 300


def test_task_lines_are_hashed_together_whatever_their_lengths(spark):
    """Hashes of a few long lines among short ones; a line of a million bytes took a time that grew with its square."""

    def fnv(data: bytes) -> str:
        h = 0x811C9DC5
        for b in data:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    bodies = ["a", "é" * 700, "x" * 1_000_000, "b" * 699 + "𝄞", *(f"{k}" * k for k in range(40)), "a"]
    assert tasks.fnv1a_of(bodies) == [fnv(b.encode()) for b in bodies] and tasks.fnv1a_of([]) == []
    text = "\n".join(f"- [/] {b}" for b in bodies)
    rows = tasks.extract_tasks(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id long, text string")).select("line", "hash").collect()
    assert {r["line"]: r["hash"] for r in rows} == {n: fnv(f"- [/] {b}".strip().encode()) for n, b in enumerate(bodies, 1)}


def test_pairs_leave_their_blocks_whole_and_unshuffled(spark, monkeypatch):
    """Blocks of any size give the cosines, best terms and words of all pairs, also where a vector lacks terms, products are equal, and the
    dictionary lacks terms or has two words for one; no pair meets a vector or a word by a join."""
    rnd = random.Random(8)
    rows = [(i, t, rnd.choice([-1.0, 0.5, 0.5, 2.0])) for i in range(50) for t in rnd.sample(range(12), rnd.randint(1, 12))]
    terms = spark.createDataFrame(rows, "id long, term int, weight double")
    subjects = spark.createDataFrame([(i,) for i in (*range(0, 50, 5), 99)], "id long")
    dictionary = spark.createDataFrame([(t, f"w{t}") for t in range(12) if t % 4] + [(1, "a1"), (77, "x")], "term int, word string")
    held, best, words = {}, {}, {}
    for i, t, w in rows:
        held.setdefault(i, {})[t] = w
    for s in range(0, 50, 5):
        for i in held:
            if common := sorted(held[s].keys() & held[i].keys(), key=lambda t: (-held[s][t] * held[i][t], t)):
                best |= {(s, i, n): t for n, t in enumerate(common[:3], 1)}
                if known := [{1: "a1"}.get(t, f"w{t}") for t in common[:3] if t % 4]:
                    words[s, i] = known
    cosines = sorted(map(tuple, related.cosine_pairs(terms, subjects).collect()))
    for block in ((1024, 1024), (3, 7)):
        monkeypatch.setattr(related, "PAIR_BLOCK", block)
        monkeypatch.setattr(related, "CELLS", 1 << 21 if block[0] > 3 else 8)
        made = related.every_top_shared_terms(terms, subjects)
        assert {(r["subject"], r["id"], r["place"]): r["term"] for r in made.collect()} == best and made.count() == len(best)
        spelt = related.every_shared_words(terms, subjects, dictionary)
        assert {(r["subject"], r["id"]): r["words"] for r in spelt.collect()} == words
        assert sorted(map(tuple, related.cosine_pairs(terms, subjects).collect())) == cosines
        for plan in (made, spelt):
            after = plan._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
            assert "Exchange" not in after and "Join" not in after


def test_shared_mediators(spark, monkeypatch):
    from tarn.operators import artifact

    rnd = random.Random(6)
    links = [(i, m) for i in range(60) for m in rnd.sample(range(12), 3)] + [(i, 99) for i in range(60)] + [(1, 99), (2, None), (None, 3)]
    count = lambda a, b: len({m for i, m in links if i == a} & {m for i, m in links if i == b} - {None})
    wanted = sorted((a, b, count(a, b)) for a in range(0, 60, 7) for b in range(60) if a != b and count(a, b))
    df, asked = spark.createDataFrame(links, "id long, mediator long"), spark.createDataFrame([(a,) for a in range(0, 60, 7)], "id long")
    for salt in (2048, 8):  # the hub dealt to one task, and to eight
        monkeypatch.setattr(artifact, "NEIGHBOURS_A_SALT", salt)
        assert sorted(map(tuple, artifact.shared_mediators(df, asked).collect())) == wanted
    top = artifact.held_list(artifact.shared_mediators(df, asked), 5).filter("subject = 7").orderBy("position").collect()
    assert [r["id"] for r in top] == [b for a, b, n in sorted(wanted, key=lambda w: (-w[2], w[1])) if a == 7][:5]


def test_subjects_without_words_are_ranked(spark):
    arm = spark.createDataFrame([(9, 1, 1)], "subject long, id long, rank int")
    words = spark.createDataFrame([(5, 10)], "subject long, wc int")
    paths = spark.createDataFrame([(1, "a.md")], "id long, path string")
    assert [tuple(r) for r in related.fuse(arm, arm.limit(0), arm.limit(0), words, paths).collect()] == [(9, 1, round(1 / 61, 4), 1)]


def test_ages(spark):
    made = spark.createDataFrame([(x,) for x in (-9, 0, 59, 60, 3599, 3600, 86399, 86400, 900000)], "x long").select(rules.human_age(F.col("x")), rules.human_until(F.col("x"))).collect()
    assert [r[0] for r in made] == ["just now"] * 3 + ["1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "10d ago"]
    assert [r[1] for r in made] == ["expired", "expired", "in 1m", "in 1m", "in 59m", "in 1h", "in 23h", "in 1d", "in 10d"]


def test_units_labels_and_folders(spark):
    office = "application/vnd.openxmlformats-officedocument."
    kinds = [office + "presentationml.presentation", office + "spreadsheetml.sheet", office + "presentationml.presentation; x", "application/vnd.oasis.opendocument.presentation", "application/pdf", None]
    assert values(spark, kinds, rules.unit_label) == ["slide", "sheet", "page", "page", "page", "page"]
    assert values(spark, ["-" + "a" * 70, "My Notes_v.2", "a--b", "a!-b", "x" * 63 + "-y", "--"], rules.sanitize_label)[:5] == ["a" * 63, "my-notes-v-2", "a-b", "a-b", "x" * 63]
    assert values(spark, ["@team", "@@ a b ", "заметки/2", "--", "Ⅻ½-x"], rules.safe_directory) == ["team", "a-b", "заметки-2", "workspace", "Ⅻ½-x"]
    assert values(spark, ["@team"], lambda c: rules.default_directory(c, ".m")) == [".m/team"]


def test_highlight_keeps_every_character(spark):
    made = values(spark, ["a\x01<b>x\x01</b>", "<b></b>", "<b><b>x</b>", "", "a</b"], rules.highlight_runs)
    assert [[(r["text"], r["hit"]) for r in runs] for runs in made] == [[("a\x01", False), ("x\x01", True)], [], [("<b>x", True)], [], [("a</b", False)]]


def test_names_are_measured_as_they_stand_on_disk(spark):
    rows = spark.createDataFrame([(1, "file", '"' * 60 + "x" * 150 + ".md", False), (2, "file", '"' * 90 + ".md", False), (3, "file", "Ж" * 200 + ".md", False)], "id long, kind string, path string, trashed boolean")
    none = spark.createDataFrame([], "id long")
    got = lambda windows: [r["disposition"] for r in changes.classify(rows, none, windows=windows).orderBy("id").collect()]
    assert got(False) == ["put", "put", "park"] and got(True) == ["park", "park", "put"]


def test_exact_cosine(spark):
    a = F.array(F.struct(F.lit(1).alias("term"), F.lit(3.0).cast("float").alias("weight")), F.struct(F.lit(2).alias("term"), F.lit(4.0).cast("float").alias("weight")))
    b = F.array(F.struct(F.lit(2).alias("term"), F.lit(2.0).cast("float").alias("weight")))
    assert spark.range(1).select(related.exact_cosine(a, b)).first()[0] == pytest.approx(0.8)


def test_filter_parse():
    f = Filter.parse(["a"], ["#t"], ["k=1", "k=2", "n=1..", "e="])
    assert f.fields == {"k": ["1", "2"], "e": [""]} and f.ranges == {"n": ("1", None)} and f.tags == ["t"]
    f = Filter.parse([], [], [" price = 5 ", "p= a .. b ", "p=c", "q=..7"])
    assert f.fields == {"price": ["5"], "p": ["c"]} and f.ranges == {"p": ("a", "b"), "q": (None, "7")}
    for bad in (["novalue"], ["=x"], ["  =x"], ["n=.."], ["n= .. "], ["n=1..2", "n=3..4"]):
        with pytest.raises(ValueError):
            Filter.parse([], [], bad)


def test_values_and_range_of_a_key_are_alternatives(spark):
    rows = spark.createDataFrame([("a",), ("1,5",), ("3",), (None,), ("2024-02-03",)], "p string")
    got = lambda *specs, **kinds: [r["p"] for r in rows.filter(_with_kinds(Filter.parse([], [], list(specs)), kinds).predicate()).collect()]
    assert got("p=a", "p=1..2") == ["a", "1,5"] and got("p=1..2", "p=") == ["1,5", None]
    assert got("p=x..y") == [] and got("p=1..y") == [] and got("p=..2") == ["1,5"] and got("p=1,5..3") == ["1,5", "3"]
    assert got("p=2024-01-01..", p="date") == ["2024-02-03"] and got("p=1..9", p="date") == []


def _with_kinds(where, kinds):
    where.kinds = kinds
    return where


def plain_fixpoint(rows, incumbents=(), parks=()):
    """The rule as a loop: rows (id, path, seq, parked)."""
    key = lambda p: unicodedata.normalize("NFC", p).lower()
    ids, parked = {r[0] for r in rows}, {}
    for _ in range(len(rows) + 2):
        prefixes = [p + "/" for i, p in parks if i not in ids] + [p + "/" for i, p, _, arrived in rows if arrived or i in parked]
        exact, folded, made = {}, {}, {}
        for i, p in incumbents:
            if i not in ids:
                exact.setdefault(p, i), folded.setdefault(key(p), i)
        for i, p, _, arrived in sorted(rows, key=lambda r: (r[2], r[0])):
            if arrived:
                continue
            if any(p.startswith(x) for x in prefixes):
                made[i] = "ancestor"
            elif p in exact:
                made[i] = "projection"
            elif key(p) in folded:
                made[i] = "fold"
            else:
                exact[p] = folded[key(p)] = i
        stable, parked = made.keys() == parked.keys(), made
        if stable:
            break
    return {i: "classified" if arrived else parked.get(i) for i, _, _, arrived in rows}


def fixpoint(spark, rows, incumbents=(), parks=()):
    frame = lambda some: spark.createDataFrame(list(some), "id long, path string")
    made = changes.collision_fixpoint(spark.createDataFrame(rows, "id long, path string, seq long, parked boolean"), frame(incumbents), frame(parks))
    return {r["id"]: r["park"] for r in made.collect()}


def test_fixpoint_parks_what_lies_under_a_parked_folder(spark):
    rows = [(1, "A", 1, False), (2, "a", 2, False), (3, "a/x.md", 3, False), (4, "A/y.md", 4, False), (5, "P", 5, True), (6, "P/z.md", 6, False)]
    assert fixpoint(spark, rows) == {1: None, 2: "fold", 3: "ancestor", 4: None, 5: "classified", 6: "ancestor"} == plain_fixpoint(rows)
    rows = [(1, "A", 1, False), (2, "A", 2, False), (3, "A/x.md", 3, False)]
    assert fixpoint(spark, rows) == {1: None, 2: "projection", 3: "ancestor"} == plain_fixpoint(rows)


def test_fixpoint_equals_the_loop(spark):
    rnd, names = random.Random(6), ["a", "A", "b", "É", "é"]
    for _ in range(4):
        some = lambda n, low: [(low + i, "/".join(rnd.choices(names, k=rnd.randint(1, 3)))) for i in range(n)]
        rows = [(i, p, rnd.randint(0, 20), rnd.random() < 0.1) for i, p in some(25, 0)]
        held, parks = some(3, 20), some(2, 24)  # some of them delivered
        assert fixpoint(spark, rows, held, parks) == plain_fixpoint(rows, held, parks)


def test_fixpoint_runs_as_long_as_it_takes(spark):
    """Each step of the chain parks only when the one before it has: far more rounds than any fixed bound."""
    chain = []
    for k in range(30):
        chain += [(2 * k, f"d{k}", 10 * k + 1, False), (2 * k + 1, f"d{k}/e", 10 * k, False)]
    rows = [(1000, "d0", 0, False)] + chain
    for k in range(1, 30):  # a child of d(k-1) claims d(k) once its own folder parks
        rows.append((2000 + k, f"d{k - 1}/D{k}", 5, False))
    assert fixpoint(spark, rows) == plain_fixpoint(rows)


def test_reserved_segments_are_skipped_and_instruction_names_count_below_the_scope(spark):
    rows = spark.createDataFrame([(1, "file", ".git/x.md", False), (2, "file", ".git/y.md", False), (3, "file", ".github/d/ok.md", False), (4, "file", ".github/d/.cursor/no.md", False)], "id long, kind string, path string, trashed boolean")
    got = {r["id"]: (r["disposition"], r["reason"]) for r in changes.classify(rows, rows.filter("id = 1"), ".github/d").collect()}
    assert got == {1: ("remove", "reserved"), 2: ("ledger_only", "reserved"), 3: ("put", None), 4: ("park", "instruction_name")}


def found(spark, text, *names):
    made = tasks.extract_tasks(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("ordinal")
    return [tuple(r[n] for n in names) for r in made.collect()]


def fnv(data):
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 % 2**32
    return f"{h:08x}"


def test_task_marks(spark):
    marks = "".join(f"- [{m}] one {i}\n" for i, m in enumerate(" /hxX-"))
    assert [c for (c,) in found(spark, marks, "category")] == ["open", "in_progress", "waiting", "done", "done", "dropped"]
    assert found(spark, "- [>] a\n- [*] b\n- []\n- [x]b\n- c\n[ ] d\n* e [ ]\n", "text") == []
    assert found(spark, "- [ ]\n3) [x] y\n+ [/]\tz", "line", "text") == [(1, ""), (2, "y"), (3, "z")]


def test_task_fields_dates_and_identity(spark):
    text = "- [ ] write [who:: A B] it [[page|name]] [size::2] ⏳ 2025-03-01 ✅ 2025-04-01 ^t-9\n- [x] a ^own-1\n- [ ] b  \n- [ ] 2^8 📅 2025-02-30"
    assert found(spark, text, "text", "fields", "dates", "task_id", "block_id") == [
        ("write it [[page|name]]", ["who=A B", "size=2"], ["scheduled=2025-03-01", "done=2025-04-01"], "t-9", None), ("a", [], [], None, "own-1"), ("b", [], [], None, None), ("2^8 📅 2025-02-30", [], [], None, None),
    ]
    assert found(spark, "  > - [ ] b  ", "hash") == found(spark, "- [ ] b", "hash") == found(spark, "- [ ] b %%c%%", "hash") == [(fnv(b"- [ ] b"),)]
    assert found(spark, "- [ ] b [k:: v]", "hash") == [(fnv(b"- [ ] b [k:: v]"),)]
    assert values(spark, ["a", "", "é"], tasks.fnv1a) == ["e40c292c", "811c9dc5", fnv("é".encode())]


def test_task_dates_are_read_from_the_end(spark):
    rows = ["a 📅 2025-02-30 ✅ 2025-04-01", "📅 2025-01-02", "a📅 2025-01-02", "a ✅️2025-01-02   ⏳ 2025-01-03", "✅ 2025-01-02 b", "a [x:: 1] ✅ 2025-01-02 [y:: `z [q:: r]`] 📅 2025-01-03"]
    got = found(spark, "\n".join("- [ ] " + r for r in rows), "text", "dates", "fields")
    assert got == [
        ("a 📅 2025-02-30", ["done=2025-04-01"], []), ("", ["due=2025-01-02"], []), ("a📅 2025-01-02", [], []), ("a", ["done=2025-01-02", "scheduled=2025-01-03"], []),
        ("✅ 2025-01-02 b", [], []), ("a ✅ 2025-01-02", ["due=2025-01-03"], ["x=1", "y=`z [q:: r]`"]),
    ]
    assert found(spark, "- [ ] a \0 `b  c` ``d`e`` #t `#u`", "text", "tags") == [("a \0 `b c` ``d`e`` #t `#u`", ["t"])]


def test_task_nesting(spark):
    text = "- [ ] a\n  - plain\n    - [ ] b\n      1. [x] c\n  - [ ] d\n\n  more of a\n  - [ ] e\n\nend\n  - [ ] f\n> - [ ] q\n>   - [ ] r\n"
    assert found(spark, text, "text", "parent") == [("a", None), ("b", 0), ("c", 1), ("d", 0), ("e", 0), ("f", None), ("q", None), ("r", 6)]


def test_tasks_in_code_and_comments_are_not_read(spark):
    text = "~~~\n- [ ] fenced\n```\n~~~\n- [ ] a `[owner:: x] #no`\n\n      - [ ] code in the item\n%%\n- [ ] hidden\n%%\n- [ ] b %%[owner:: y]%% c\n"
    assert found(spark, text, "text", "fields", "is_task", "tags") == [("a `[owner:: x] #no`", [], False, []), ("b c", [], False, [])]
    assert found(spark, "\n    - [ ] code\n\t- [ ] code\n", "text") == []


def test_task_switch_and_signals(spark):
    signals = "- [ ] a [check:: 1]\n- [/] b\n- [ ] c 📅 2025-01-01\n- [ ] d ^t-1\n- [ ] e [size:: 2] ^x #tag\n"
    assert [x for (x,) in found(spark, signals, "is_task")] == [True] * 4 + [False]
    assert [x for (x,) in found(spark, "---\ntasks: true\n---\n" + signals, "is_task")] == [True] * 5
    assert [x for (x,) in found(spark, "---\na: b\ntasks: false\n---\n" + signals, "is_task")] == [False] * 5
    assert [x for (x,) in found(spark, "---\ntasks: 1\n---\n" + signals, "is_task")] == [True] * 4 + [False]
    assert found(spark, "---\ntasks: true\n- [ ] a", "line", "is_task") == [(3, False)]  # never closed


def test_task_tags(spark):
    assert found(spark, "- [ ] #One and #two/sub #ONE a#b ==#three== &#39; #42 #4x", "tags") == [(["One", "two/sub", "three", "4x"],)]


def test_tasks_as_rows(spark):
    docs = spark.createDataFrame([(1, "- [ ] a\n- [h] b #t"), (2, None), (3, ""), (1, "- [ ] a")], "id long, text string")
    got = sorted((r["id"], r["ordinal"], r["text"], tuple(r["tags"]), r["is_task"]) for r in tasks.extract_tasks(docs).collect())
    assert got == [(1, 0, "a", (), False), (1, 0, "a", (), False), (1, 1, "b #t", ("t",), True)]


def test_tasks_of_documents_by_a_plain_search(spark, sf_dir):
    """The registered query: every line that begins with a capital letter is an item, and none nests."""
    from tarn.plans import catalogue

    wanted, docs = [], [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if "%%" not in (r["text"] or "")]
    for r in docs:
        lines = (r["text"] or "").split("\n")
        n = 0
        for number, line in enumerate(lines, 1):
            if line[:1].isupper():
                wanted.append((r["doc_id"], n, number, fnv(("- [/] " + line.rstrip()).encode())))
                n += 1
    got = [r for r in catalogue.queries()["markdown_tasks"](spark, sf_dir).collect() if r["id"] in {r["doc_id"] for r in docs}]
    plain = [r for r in got if not r["dates"] and not r["fields"]]
    assert len(plain) > 100 and {(r["id"], r["ordinal"], r["line"], r["hash"]) for r in plain} <= set(wanted)
    assert {r["category"] for r in got} == {"in_progress"} and all(r["is_task"] for r in got) and {r["parent"] for r in got} == {None}
    assert len(wanted) == len(got)


def test_front_matter(spark):
    texts = ["---\ndescription: a\n  b\nwhen: c\n---\n", "---\ndescription: a\n\n  b\n---", "---\nname: a\n---\ndescription: x", "description: a", "---\ndescription:\n b\n:c\n---"]
    assert values(spark, texts, lambda c: rules.front_matter_value(c, "description")) == ["a b", "a", None, None, " b :c"]


def test_tool_paths(spark):
    calls = [
        '{"tool_name": "Write", "tool_input": {"path": " a ", "file_path": 3, "edits": [{"filePath": "b"}, 4], "paths": ["c", 5, ""]}}',
        '{"tool_name": "mcp__x__y", "tool_input": {"path": "a"}}',
        '{"tool_input": {"command": "*** Move to: x \\r\\n *** Add File: no\\n*** Add File: y z\\n*** Delete File: "}}',
        '{"tool_name": "Write"}', "not json", None,
    ]
    assert values(spark, calls, rules.candidate_paths) == [[" a ", "b", "c"], [], ["x", "y z"], [], [], []]


def test_callbacks(spark):
    lines = ["GET /callback?code=a%20b+c%2&state=%D0%BC HTTP/1.1", "GET", "GET /x?code=1", "GET /callback?error=no&code=1&state=2", "GET /callback?state=2", "GET /callback?code=1&code=2&state"]
    got = [(r["code"], r["state"], r["problem"]) for r in values(spark, lines, rules.parse_callback)]
    assert got == [("a b c%2", "м", None), (None, None, "malformed"), (None, None, "unexpected_path"), (None, None, "refused"), (None, None, "no_code"), ("2", "", None)]
