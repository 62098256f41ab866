"""The corpus pipeline against a plain version of its stages, awkward inputs for the chain, and the training queries' SQL."""

import glob
import itertools
import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from tarn.llm import pii, queries
from tests.test_oracle import rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_quality(text):
    """Whether the standard policy keeps a text, by its rules as they are stated."""
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + d for i, w in enumerate(windows) if w in twice for d in range(3)}
    n, chars = len(words), sum(map(len, words))
    count = lambda chars: sum(text.count(c) for c in chars)
    veto = [
        n < 50, 100 * len(covered) > 50 * n, count("#*$%&<>") > 0.5 * n, len(lines) >= 4 and len(lines) - len(set(lines)) > 0.4 * len(lines), text.count("!") > 0.5 * n, text.count("|") > 0.3 * n,
    ]
    vote = [chars > 25 * n or chars < 1.5 * n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.7 * chars]
    return not any(veto) and sum(vote) < 2


def plain_pipeline(rows):
    """{id: text} of the rows (id, text) that stay after the first four stages; ids are distinct."""
    kept = {i: t or "" for i, t in rows if plain_quality(t or "")}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    last = {}
    for i, t in kept.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    kept = {i: kept[i] for i in last.values()}

    def shingles(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(kept), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = {i: t for i, t in kept.items() if find(i) == i}
    model = pii.model_from(pii.trained())
    return {i: pii.mask_text(t, pii.find_spans([t], model)[0][1]) for i, t in kept.items()}


@pytest.fixture(scope="module")
def planted():
    """Clean documents, exact and near copies of some, junk, repeated lines, and personal data."""
    rnd = random.Random(21)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(rnd.randint(60, 200))) for i in range(60)]
    for i in range(60, 80):
        source = rows[rnd.randrange(20)][1]
        rows.append((i, source.upper() if i % 3 == 0 else source))
    for i in range(80, 110):
        words = rows[rnd.randrange(20, 30)][1].split()
        for _ in range(2):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(110 + i, t) for i, t in enumerate(["too short", "same line\n" * 40, "!!! " * 80 + prose(60), "a | " * 60, "", None])]
    for i, extra in enumerate(["mail jo.doe@site.org now", "call +1 (499) 555-6503 today", "card 4111 1111 1111 1111 here", "host 10.20.30.40 up"]):
        rows.append((120 + i, prose(70) + " " + extra + " " + prose(20)))
    rnd.shuffle(rows)
    return rows


def run_on(spark, rows, folder):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_equals_plain_stages(spark, planted, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in planted], SCHEMA)
    wanted = plain_pipeline(planted)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert got == {i: (t, len(t)) for i, t in wanted.items()}
    assert {i for i in range(20, 60) if i >= 30} <= got.keys() and {120, 121, 122, 123} <= got.keys()  # clean documents stay
    assert not any(re.search(r"@site|555-6503|4111|10\.20", t) for t, _ in got.values())
    packed = {r["doc_id"]: r for r in run_on(spark, planted, tmp_path).collect()}
    assert {i: r["length"] for i, r in packed.items()} == {i: len(t.split()) for i, t in wanted.items()}
    filled = {}
    for r in packed.values():
        filled[r["bucket"], r["batch"]] = filled.get((r["bucket"], r["batch"]), 0) + r["bucket_length"]
    assert max(filled.values()) <= queries.TOKEN_BUDGET


def test_pipeline_of_an_empty_table_and_of_awkward_rows(spark, tmp_path):
    assert run_on(spark, [], tmp_path / "none").count() == 0
    rnd = random.Random(4)
    text = " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(80))
    other = " ".join(f"v{rnd.randint(0, 9999)}" for _ in range(80))
    rows = [(None, text + " x"), (1, text), (1, text), (1, other), (2, other + " tail"), (None, None), (3, None), (3, "")]
    got = run_on(spark, rows, tmp_path / "odd").collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == [("1", 80), ("1", 80), ("None", 81)]  # a row without an id is no copy of another


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_training_query_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_ablation_by_brute_force(spark, sf_dir):
    from tarn.llm import quality_rules as q

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bits = [r["fail_bits"] for r in q.ledger(docs).collect()]

    def rejected(b, without=None):
        veto, vote = (sum(q.BIT[r] for r in rules if r != without) for rules in (q.STANDARD.veto, q.STANDARD.vote))
        return b & veto != 0 or (vote != 0 and bin(b & vote).count("1") >= q.STANDARD.votes)

    wanted = {r: (sum(b & q.BIT[r] != 0 for b in bits), sum(rejected(b) and not rejected(b, r) for b in bits)) for r in (*q.STANDARD.veto, *q.STANDARD.vote)}
    assert {r["rule"]: (r["n_failed"], r["n_only_by_this"]) for r in q.ablation(q.ledger(docs)).collect()} == wanted


def test_personal_data_on_documents_by_brute_force(spark, sf_dir):
    """Base spans of whole documents by the expressions themselves; and how many of them the model finds on its own."""
    import hashlib

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def spans(t):
        digits = lambda s: "".join(c for c in s if c in "0123456789")
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m[0])) <= 15])

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        base = spans(docs[r["doc_id"]])
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x == n for _, x, _ in base) for n in range(4)]
        assert not base or set(written.split(",")) <= set(r["spans"].split(","))
