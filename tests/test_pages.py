"""Pull by key, and pages of a change log applied to a mirror's books, against a plain loop."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tarn.sources import pull, scratch
from tarn.streaming import pages

ROW = "id long, rev long, kind string, path string, trashed boolean, sha string, stamp string"
SUFFIX = ".ctl"


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}"


def numbered(spark, *keys):
    return spark.createDataFrame([(r, i, f"b{i}") for r, i in keys], "rev long, id long, body string")


def test_pull_pages_resume_at_the_saved_key(spark, at):
    keys = [(n // 7 + 1, n) for n in range(23)] + [(2, -9), (4, 10**12)]
    pull.publish(numbered(spark, *keys).repartition(3), f"{at}/log", 7, 25)
    assert (pull.head(spark, f"{at}/log")["epoch"], pull.head(spark, f"{at}/log")["live_nodes"]) == (7, 25)
    seen = []

    def step(rows, number):
        seen.append((number, sorted((r["rev"], r["id"]) for r in rows.collect())))

    run = lambda checkpoint, start=pull.START, **more: pull.collected_pages(pull.pull(spark, f"{at}/log", start, 7, page=5, **more), f"{at}/{checkpoint}", step)
    run("one")
    assert [x for _, some in seen for x in some] == sorted(keys) and [len(x) for _, x in seen] == [5] * 5
    seen.clear()
    run("one", max(keys))
    assert seen == []
    more = [(9, n) for n in range(3)]
    pull.publish(numbered(spark, *more), f"{at}/log", 7, 28)
    run("one", max(keys))
    assert seen == [(5, more)]
    seen.clear()
    run("two", (2, 8), pages=2)  # a reader that has applied up to (2, 8), two pages a batch
    assert [len(x) for _, x in seen] == [10, 8] and [x for _, some in seen for x in some] == [k for k in sorted([*keys, *more]) if k > (2, 8)]
    with pytest.raises(pull.EpochChanged):
        pull.pull(spark, f"{at}/log", epoch=8)


def test_a_page_reads_small_row_groups_and_is_planned_once(spark, at, monkeypatch):
    monkeypatch.setattr(pull, "GROUP_ROWS", 20)
    pull.publish(numbered(spark, *((n, n) for n in range(1, 401))).coalesce(1), f"{at}/log", 1, 400)
    reader = pull.KeysetReader({"path": f"{at}/log", "rev": "0", "id": "0", "page": "10", "pages": "7"}, ["rev", "id", "body"])
    end = reader.latestOffset()
    made = reader.partitions({"rev": 0, "id": 0}, end)
    assert end == {"rev": 70, "id": 70} and made is reader.made and len(made) == 7
    for n, page in enumerate(made):
        rows = sum(pull.pq.ParquetFile(path).metadata.row_group(g).num_rows for path, g in page.groups)
        assert rows <= 40 and [b.column("rev").to_pylist() for b in reader.read(page) if b.num_rows] and sum(b.num_rows for b in reader.read(page)) == 10
    assert [p.high for p in reader.partitions({"rev": 0, "id": 0}, {"rev": 35, "id": 35})] == [(10, 10), (20, 20), (30, 30), (35, 35)]  # planned before a restart


def test_a_run_that_stops_in_mid_log_goes_on(spark, at):
    keys = [(n + 1, n) for n in range(30)]
    pull.publish(numbered(spark, *keys), f"{at}/log", 1, 30)
    applied, broken = {}, [True]

    def step(rows, number):
        if number == 2 and broken:
            broken.clear()
            raise RuntimeError("stopped")
        applied[number] = sorted(r["id"] for r in rows.collect())

    with pytest.raises(Exception, match="stopped"):
        pull.collected_pages(pull.pull(spark, f"{at}/log", page=8), f"{at}/cp", step)
    assert sorted(applied) == [0, 1]
    pull.collected_pages(pull.pull(spark, f"{at}/log", keys[15], page=8), f"{at}/cp", step)
    assert applied == {0: list(range(8)), 1: list(range(8, 16)), 2: list(range(16, 24)), 3: list(range(24, 30))}


def key_of(path):
    return unicodedata.normalize("NFC", path).lower()


def place_of(kind, path):
    return path + SUFFIX if kind == "attachment" else path


def disposition(row, nodes):
    i, _, kind, path, trashed, _, _ = row
    name = path.rpartition("/")[2]
    if trashed or kind not in ("file", "folder", "attachment") or any(x.lower() in (".git", ".trash", ".obsidian") for x in path.split("/")):
        return "remove" if i in nodes else "ledger_only"
    if any(x.lower().endswith(SUFFIX) for x in path.split("/")) or kind == "file" and not name.lower().endswith(".md") or name.lower() == ".md" and kind == "file":
        return "park"
    return "put"


class Plain:
    """The rules as a loop over dictionaries."""

    def __init__(self):
        self.nodes, self.ledger, self.parks, self.debts = {}, set(), {}, set()

    def page(self, rows, full, disk):
        rows = sorted({r[0]: r for r in sorted(rows, key=lambda r: r[1])}.values(), key=lambda r: (r[1], r[0]))
        told = {r[0]: disposition(r, self.nodes) for r in rows}
        incumbents = [(i, n["path"]) for i, n in self.nodes.items() if i not in told and i in self.ledger]
        parked = {}
        for _ in range(len(rows) + 2):
            above = [p + "/" for i, (p, *_) in self.parks.items() if i not in told] + [r[3] + "/" for r in rows if told[r[0]] == "park" or r[0] in parked]
            exact, folded, made = {p for _, p in incumbents}, {key_of(p) for _, p in incumbents}, {}
            for r in rows:
                if told[r[0]] == "put":
                    if any(r[3].startswith(a) for a in above):
                        made[r[0]] = "ancestor"
                    elif r[3] in exact:
                        made[r[0]] = "projection"
                    elif key_of(r[3]) in folded:
                        made[r[0]] = "fold"
                    else:
                        exact.add(r[3]), folded.add(key_of(r[3]))
            if made.keys() == parked.keys():
                parked = made
                break
            parked = made
        owned = {key_of(n["place"]) for n in self.nodes.values()}
        work, gone, done = set(), [], {}
        for i, rev, kind, path, trashed, sha, _ in rows:
            (self.ledger.discard if trashed else self.ledger.add)(i)
            before = self.nodes.pop(i, None)
            self.parks.pop(i, None)
            if told[i] in ("park", "put"):
                place, folder = place_of(kind, path), kind == "folder"
                if told[i] == "park" or i in parked:
                    self.parks[i] = (path, "structural", parked.get(i, "x"))
                else:
                    met = disk.get(place)
                    if met is None or folder and met[0]:
                        outcome = "write"
                    elif folder != met[0]:
                        outcome = "late" if key_of(place) in owned else None
                    elif key_of(place) in owned:
                        mine = before and key_of(before["place"]) == key_of(place) and before["sha"]
                        outcome = "overwrite_edit" if mine and met[1] not in (before["sha"], sha) else "overwrite"
                    else:
                        outcome = "adopt" if met[1] == sha else None
                    if outcome is None:
                        self.parks[i] = (path, "transient", "occupied")
                    else:
                        done[i] = {"path": path, "place": place, "kind": "note" if kind == "file" else kind, "rev": rev, "sha": "" if folder else sha}
                        work.add((4, "write", i, place) if outcome == "late" else (1, outcome, i, place))
            if before:
                gone.append((i, before))
        self.nodes |= done
        standing = {key_of(n["place"]) for n in self.nodes.values()}
        left = [(i, n) for i, n in gone if key_of(n["place"]) not in standing]
        files = {n["place"] for _, n in left if n["kind"] != "folder"}
        work |= {(2, "remove", i, n["place"]) for i, n in left if n["kind"] != "folder"}
        due = {n["place"] for _, n in left if n["kind"] == "folder"} | (set() if full else {d for d in self.debts if key_of(d) not in standing})
        remains = {n["place"] for n in self.nodes.values()} | {p for p in disk if p not in files and p not in due}
        owed = {d for d in due if any(p.startswith(d + "/") for p in remains)}
        work |= {(3, "remove_folder", None, d) for d in due - owed}
        self.debts = owed | (self.debts if full else set())
        return work


def tables(books):
    nodes = {r["id"]: {k: r[k] for k in ("path", "place", "kind", "rev", "sha")} for r in books.read("nodes").collect()}
    parks = {r["id"]: (r["path"], r["class"], r["reason"] if r["reason"] in ("ancestor", "projection", "fold", "occupied") else "x") for r in books.read("parks").collect()}
    return nodes, {r["id"] for r in books.read("ledger").collect()}, parks, {r["path"] for r in books.read("debts").collect()}


def random_rows(rng, n, first):
    names = ["a", "A", "b", "c.md", "C.md", "d.md", "x.txt", ".git", "é", "e.ctl"]
    path = lambda: "/".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
    return [(rng.randint(1, 40), first + k, rng.choice(["file", "file", "folder", "folder", "attachment", "odd"]), path(), rng.random() < 0.2, f"s{rng.randint(0, 4)}", None) for k in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_pages_equal_a_plain_loop(spark, at, seed):
    rng = random.Random(seed)
    books, plain, owed = pages.Books(spark, f"{at}/books", parts=3), Plain(), 0
    for number in range(3):
        rows = random_rows(rng, 28, number * 100) + [(101, number * 100 + 28, "folder", "q", number > 0, None, None), (102 + number, number * 100 + 29, "file", f"q/{number}.md", False, "s", None)]
        # an incumbent that is trashed in the page, and a durable park that is lifted in it, bar nobody
        rows = [*rows[:-4], (200, rows[-4][1], "file", "Held.md", number > 0, "s", None), (201 + number, rows[-3][1], "file", "held.MD", False, "s", None), *rows[-2:]]
        disk = {n["place"]: (n["kind"] == "folder", rng.choice([n["sha"], "s9"])) for n in plain.nodes.values() if rng.random() < 0.8}
        disk |= {p: (f, s) for p, f, s in [("d.md", False, "s1"), ("b", False, "s2"), ("a/keep.txt", False, "s3")] if p not in disk}
        there = spark.createDataFrame([(p, f, s) for p, (f, s) in disk.items()], "path string, is_folder boolean, sha string")
        full = number < 2
        work = plain.page(rows, full, disk)
        page = spark.createDataFrame(rows, ROW)
        again = 2 if number == 1 else 1
        for _ in range(again):  # a page that comes twice changes nothing
            standing = pages.apply_page(books, page, number, 30 if full else 31, pages.Riders(len(plain.ledger), True, None, "r"), 50, 7, there)
        assert {tuple(r) for r in books.work(number).collect()} == work
        assert tables(books) == (plain.nodes, plain.ledger, plain.parks, plain.debts)
        owed += len(plain.debts)
        assert books.manifest()["number"] == number and standing.at_head == (not full) and standing.rev == number * 100 + 29
    assert owed > 0 and len(plain.parks) > 3 and (standing.related, standing.graph, standing.head_reached_at) == ("r", None, 50)


def test_a_page_that_stops_before_its_manifest_changes_nothing(spark, at, monkeypatch):
    books = pages.Books(spark, f"{at}/books", parts=2)
    page = lambda *rows: spark.createDataFrame(rows, ROW)
    riders = pages.Riders(1)
    pages.apply_page(books, page((1, 1, "file", "a.md", False, "s", None)), 0, 9, riders, 5, 7)
    before = (tables(books), books.standing())
    with monkeypatch.context() as m:
        m.setattr(scratch, "write_new", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            pages.apply_page(books, page((1, 2, "file", "b.md", False, "t", None), (2, 3, "file", "c.md", False, "t", None)), 1, 9, riders, 6, 7)
    assert (tables(books), books.standing()) == before
    last = pages.apply_page(books, page((1, 2, "file", "b.md", False, "t", None)), 1, 9, pages.Riders(2), 6, 7)
    assert last.from_zero and not last.at_head and tables(books)[0][1]["path"] == "b.md"  # the server counts two: a delete was missed
    with pytest.raises(ValueError, match="live nodes"):
        pages.apply_page(books, page(), 2, 9, pages.Riders(None), 6, 7)


def test_follow_reads_pages_until_the_head(spark, at):
    rows = [(i, i + 1, "folder" if i % 5 == 0 else "file", f"f{i - i % 5}" + ("" if i % 5 == 0 else f"/n{i}.md"), False, f"s{i}", None) for i in range(20)]
    log = lambda some: spark.createDataFrame(some, ROW).select("rev", "id", "kind", "path", "trashed", "sha", "stamp")
    pull.publish(log(rows), f"{at}/log", 3, 20)
    books = pages.Books(spark, f"{at}/books", parts=2)
    run = lambda live: pages.follow(books, f"{at}/log", f"{at}/cp", pages.Riders(live), 9, page=10)
    assert run(20).at_head and books.read("nodes").count() == 20
    later = [(5, 30, "folder", "f5", True, None, None), (6, 31, "file", "f0/n6.md", False, "s6", None), (10, 32, "folder", "g10", False, None, None)]
    pull.publish(log(later), f"{at}/log", 3, 19)
    last = run(19)
    assert last.at_head and (last.rev, last.id) == (32, 10)
    assert {r["path"] for r in books.read("debts").collect()} == {"f5", "f10"}  # their notes still stand in them
    pull.publish(log([(i, 40 + i, "file", f"f{i - i % 5}/n{i}.md", True, None, None) for i in (7, 8, 9)]), f"{at}/log", 3, 16)
    assert run(16).at_head and {r["path"] for r in books.read("debts").collect()} == {"f10"}
    assert "f5" in {r["path"] for r in books.work(books.manifest()["number"]).filter("op = 'remove_folder'").collect()}


def wide_rows(rng, n, first):
    """Rows that seldom meet: most are new notes of their own, some move, vanish, clash in another letter case, or are folders above the others."""
    out = []
    for k in range(n):
        i, u = first + k, rng.random()
        top = f"d{rng.randint(0, 4)}"
        if u < 0.6:
            out.append((i, i, "file", f"{top}/{i}.md", False, "s", None))
        elif u < 0.75:
            j = rng.randint(1, max(1, i - 1))
            out.append((j, i, "file", rng.choice([f"{top}/{j}.md", f"m/{j}.md", f"M/{j}.MD"]), rng.random() < 0.4, "t", None))
        elif u < 0.92:
            out.append((i, i, rng.choice(["file", "attachment"]), f"{top.upper()}/{rng.randint(1, i)}.{rng.choice(['MD', 'md', 'txt'])}", False, "u", None))
        else:
            out.append((-rng.randint(1, 5), i, rng.choice(["folder", "file"]), rng.choice([top, f"{top}.txt", f"{top}/{rng.randint(1, i)}.md"]), rng.random() < 0.5, "v", None))
    return out


@pytest.mark.parametrize("seed", [110])
def test_runs_of_pages_equal_a_plain_loop(spark, at, seed):
    rng, size, count = random.Random(seed), 6, 8
    books, plain, work = pages.Books(spark, f"{at}/books", parts=2), Plain(), set()
    books.vacuum = lambda keep=2: None
    rows = wide_rows(rng, size * count - 2, 1)
    of_page = [rows[low : low + size] for low in range(0, len(rows), size)]
    for some in of_page:
        work |= plain.page(some, len(some) == size, {})
    log = spark.createDataFrame([(n, *row) for n, some in enumerate(of_page) for row in some], "page int, " + ROW)
    for _ in range(2):  # a batch that comes twice changes nothing
        standing = pages.apply_pages(books, log, 0, size, pages.Riders(len(plain.ledger)), 50, 7)
    assert tables(books) == (plain.nodes, plain.ledger, plain.parks, plain.debts)
    versions = books.manifest()["number"] + 1
    assert 1 < versions < count and standing.at_head and standing.rev == rows[-1][1] and len(plain.parks) > 3
    assert {tuple(r) for n in range(versions) for r in books.work(n).collect()} == work


def test_pages_that_do_not_meet_are_one_version(spark, at):
    rows = [(i, i, "file", f"f/{i}.md", False, "s", None) for i in range(1, 31)]
    books = pages.Books(spark, f"{at}/books", parts=2)
    pull.publish(spark.createDataFrame(rows, ROW).select("rev", "id", "kind", "path", "trashed", "sha", "stamp"), f"{at}/log", 3, 30)
    assert pages.follow(books, f"{at}/log", f"{at}/cp", pages.Riders(30), 9, page=4).at_head
    assert books.manifest()["number"] == 0 and books.read("nodes").count() == 30


def test_a_batch_that_stopped_between_its_runs_goes_on(spark, at, monkeypatch):
    rows = [(0, 1, 1, "file", "a.md", False, "s", None), (0, 2, 2, "file", "b.md", False, "s", None), (1, 1, 3, "file", "c.md", False, "s", None), (1, 3, 4, "file", "A.md", False, "s", None), (2, 4, 5, "file", "d.md", False, "s", None)]
    log, books = spark.createDataFrame(rows, "page int, " + ROW), pages.Books(spark, f"{at}/books", parts=2)
    assert {tuple(r) for r in pages.meetings(log, books.read("nodes"), books.read("parks")).collect()} == {(1, 0)}
    whole = pages._apply
    with monkeypatch.context() as m:
        m.setattr(pages, "_apply", lambda *a: whole(*a) if a[2] is None else (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            pages.apply_pages(books, log, 0, 2, pages.Riders(4), 5, 7)
    assert tables(books)[0].keys() == {1, 2} and books.standing().rev == 2
    assert pages.apply_pages(books, log, 0, 2, pages.Riders(4), 5, 7).at_head
    assert {i: n["path"] for i, n in tables(books)[0].items()} == {1: "c.md", 2: "b.md", 3: "A.md", 4: "d.md"} and books.manifest()["number"] == 1


def test_claims_are_appended_once(spark, at):
    from tarn.streaming import claims

    write = lambda *rows: spark.createDataFrame(list(rows), "id long, rev long").coalesce(1).write.mode("append").parquet(f"{at}/source")
    lines = lambda: sorted(tuple(r) for r in claims.appended(spark, f"{at}/log").collect())
    write((1, 5), (1, 3), (2, 7), (None, 1))
    claims.follow(spark, f"{at}/source", f"{at}/log", f"{at}/cp")
    assert lines() == [(1, 5), (2, 7)]
    write((1, 5), (1, 4), (2, 8), (3, -1))
    claims.follow(spark, f"{at}/source", f"{at}/log", f"{at}/cp")  # a run of its own: the state outlives the first
    assert lines() == [(1, 5), (2, 7), (2, 8), (3, -1)]
    claims.follow(spark, f"{at}/source", f"{at}/log", f"{at}/cp")
    assert lines() == [(1, 5), (2, 7), (2, 8), (3, -1)]
