"""States, logs, files and the sync of a mirror, on small inputs."""

import hashlib
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from tarn.operators import changes, reading, reconcile
from tarn.sources import files, scratch
from tarn.streaming import replay

LOG = "id long, rev long, trashed boolean, body string"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


@pytest.fixture
def at(spark, tmp_path):
    return f"file://{tmp_path}"


def test_replay_resumes_and_returns_the_state_without_new_files(spark, at):
    log(spark, (1, 1, False, "a"), (2, 2, False, "b")).coalesce(1).write.parquet(f"{at}/log")
    run = lambda: sorted(tuple(r) for r in replay.replay(spark, f"{at}/log", LOG, f"{at}/state", f"{at}/checkpoint", parts=4).collect())
    first = [(1, 1, False, "a"), (2, 2, False, "b")]
    assert run() == first
    assert run() == first
    log(spark, (1, 5, True, None), (3, 4, False, "c")).coalesce(1).write.mode("append").parquet(f"{at}/log")
    assert run() == [(1, 5, True, None), (2, 2, False, "b"), (3, 4, False, "c")]


def test_state_rewrites_only_what_a_batch_touches(spark, at):
    table = replay.StateTable(spark, f"{at}/state", LOG, parts=8)
    table.merge(log(spark, *[(i, i, False, "x") for i in range(40)]), 0)
    table.merge(log(spark, (7, 99, False, "y")), 1)
    assert sum(v == 1 for v in table.manifest(1).values()) == 1
    table.merge(log(spark, (7, 99, False, "y")), 1)  # the same batch again
    assert table.version(1).count() == 40 and table.version(1).filter("body = 'y'").count() == 1
    for n in range(2, 6):
        table.merge(log(spark, *[(i, 100 + n, False, "z") for i in range(40)]), n)
        table.vacuum()
    assert scratch.names_in(spark, f"{at}/state/data") == ["v=4", "v=5"] and table.version(5).filter("body = 'z'").count() == 40


def test_sync(spark, at):
    mirror = replay.Mirror(spark, f"{at}/m", LOG, parts=4)
    ids = lambda: sorted(r["id"] for r in mirror.live().collect())
    one = [(1, 1, False, "a"), (2, 2, False, "b"), (3, 3, False, "c")]
    position = mirror.sync(replay.Served(log(spark, *one), 7, 3), 50)
    assert (position.rev, position.epoch, position.from_zero, position.at_head, position.head_reached_at) == (3, 7, False, True, 50) and ids() == [1, 2, 3]
    two = [*one, (2, 4, True, None), (4, 5, False, "d")]
    assert mirror.check(replay.Served(log(spark, *two), 7, 3), 55)[0] == "behind"
    assert mirror.sync(replay.Served(log(spark, *two), 7, 3), 60).rev == 5 and ids() == [1, 3, 4]
    assert mirror.check(replay.Served(log(spark, *two), 7, 3), 61)[0] == "fresh" and mirror.position().at_head
    assert [mirror.check(replay.Served(log(spark, *two), 7, 3), 61, **{k: 1})[0] for k in ("transient_parks", "pending_removals")] == ["parked", "pending_removals"]
    with pytest.raises(replay.RolledBack):
        mirror.sync(replay.Served(log(spark, *two), 7, None), 62)
    gone = [r for r in two if r[0] != 3]  # 3 was deleted without a tombstone
    assert mirror.check(replay.Served(log(spark, *gone), 7, 2), 63)[0] == "missed_delete"
    assert mirror.sync(replay.Served(log(spark, *gone), 7, 2), 64, may_rebuild=False).from_zero and ids() == [1, 3, 4]
    assert not mirror.sync(replay.Served(log(spark, *gone), 7, 2), 65).from_zero and ids() == [1, 4]
    assert mirror.check(replay.Served(log(spark, *one), 8, 3), 66)[0] == "epoch_changed"
    assert mirror.sync(replay.Served(log(spark, *one), 8, 4), 67).from_zero and ids() == [1, 4]  # the count still differs: pending
    position = replay.Mirror(spark, f"{at}/m", LOG, parts=4).sync(replay.Served(log(spark, *one), 8, 3), 68)
    assert (position.epoch, position.from_zero) == (8, False) and ids() == [1, 2, 3]


def test_saved_tables(spark, at):
    saved = files.SavedTable(spark, f"{at}/s")
    assert saved.load() is None and saved.load_cache({"e": 1}) is None
    saved.save(spark.range(3), {"e": 1})
    saved.save(spark.range(5), {"e": 2})
    assert saved.load().count() == 5 and saved.load_cache({"e": 2}).count() == 5 and saved.load_cache({"e": 1}) is None
    assert len(scratch.names_in(spark, f"{at}/s")) == 4
    assert {os.stat(p).st_mode & 0o777 for p in pathlib.Path(f"{at[7:]}/s").glob("table-*")} == {0o700}
    scratch.put_pointer(spark, f"{at}/s/CURRENT", "no json")
    assert saved.load_cache({"e": 2}) is None
    with pytest.raises(ValueError):
        saved.load()
    saved.clear()
    saved.clear()
    assert saved.load() is None


def test_a_save_that_stops_leaves_the_old_table(spark, at, monkeypatch):
    saved = files.SavedTable(spark, f"{at}/s")
    saved.save(spark.range(3))
    held = saved.load()
    for step in ("write_new", "put_pointer"):
        with monkeypatch.context() as m:
            m.setattr(scratch, step, lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                saved.save(spark.range(7))
        assert saved.load().count() == 3
    saved.save(spark.range(5))
    assert saved.load().count() == 5 and held.count() == 3  # who reads the table before goes on
    assert sum(n.startswith("table-") for n in scratch.names_in(spark, f"{at}/s")) == 2  # nothing of the stopped ones is left
    saved.save(spark.range(6))
    assert sum(n.startswith(("table-", "CURRENT")) for n in scratch.names_in(spark, f"{at}/s")) == 4


def test_a_position_outlives_a_run_that_stops(spark, at, monkeypatch):
    mirror = replay.Mirror(spark, f"{at}/m", LOG, parts=2)
    mirror.sync(replay.Served(log(spark, (1, 1, False, "a")), 7, 1), 50)
    before = mirror.position()
    monkeypatch.setattr(scratch, "write_new", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        mirror.save(replay.Position(rev=9))
    assert mirror.position() == before


def test_files_are_written_walked_and_fetched(spark, at):
    rows = spark.createDataFrame([("a b/ü%.md", b"x"), ("a b/c/d.md", b""), ("MOUNT", b"m")], "path string, content binary")
    assert sorted(tuple(r) for r in files.write_files(rows, f"{at}/root").collect()) == [("MOUNT", 1), ("a b/c/d.md", 0), ("a b/ü%.md", 1)]
    os.makedirs(f"{at[7:]}/root/hollow/inner")
    walked = {r["path"]: (r["is_folder"], r["digest"]) for r in files.mirror(spark, f"{at}/root", ("MOUNT",)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert walked == {"a b/ü%.md": (False, sha(b"x")), "a b/c/d.md": (False, sha(b"")), **dict.fromkeys(("a b", "a b/c", "hollow", "hollow/inner"), (True, None))}
    assert not os.access(f"{at[7:]}/root/MOUNT", os.W_OK) or os.geteuid() == 0 and os.stat(f"{at[7:]}/root/MOUNT").st_mode & 0o777 == 0o444
    assert files.write_files(rows.withColumn("content", F.lit(b"new")), f"{at}/root").count() == 3 and open(f"{at[7:]}/root/MOUNT", "rb").read() == b"new"
    files.write_files(spark.createDataFrame([("7.png", b"seven"), ("8", b"eight")], "path string, content binary"), f"{at}/blobs")
    got = files.blobs(spark, f"{at}/blobs", spark.createDataFrame([(7,), (9,)], "id long")).collect()
    assert [(r["id"], bytes(r["content"])) for r in got] == [("7", b"seven")]
    with pytest.raises(Exception, match="leaves the folder"):
        files.write_files(spark.createDataFrame([("../x", b"x")], "path string, content binary"), f"{at}/root")


def test_a_task_that_dies_leaves_nothing(spark, at):
    """One row of many cannot be written: no file is, and nothing that was staged is left."""
    rows = spark.createDataFrame([(f"d{i}/f.md", b"x") for i in range(40)] + [("../out", b"x")], "path string, content binary").repartition(5)
    with pytest.raises(Exception, match="leaves the folder"):
        files.write_files(rows, f"{at}/root")
    assert [p for p in pathlib.Path(f"{at[7:]}/root").iterdir() if p.name != ".stage"] == [] and not os.path.exists(f"{at[7:]}/out")
    assert files.mirror(spark, f"{at}/root").count() == 0
    assert files.write_files(rows.filter("path <> '../out'"), f"{at}/root").count() == 40
    files.sweep_stage(spark, f"{at}/root")
    assert len(list(pathlib.Path(f"{at[7:]}/root").rglob("f.md"))) == 40 and not os.path.exists(f"{at[7:]}/root/.stage")
    assert files.mirror(spark, f"{at}/root").count() == 80


def test_files_moved_by_a_lost_attempt_are_passed_over(spark, at):
    import pyarrow as pa

    os.makedirs(f"{at[7:]}/stage/t/a")
    pathlib.Path(f"{at[7:]}/stage/t/a/f").write_bytes(b"1")
    batch = pa.RecordBatch.from_arrays([pa.array(["t"]), pa.array(["a/f"]), pa.array([1])], ["folder", "path", "size"])
    for _ in range(2):
        assert [b.to_pylist() for b in files._placed(iter([batch]), f"{at}/root", f"{at}/stage", True)] == [[{"path": "a/f", "size": 1}]]
    assert pathlib.Path(f"{at[7:]}/root/a/f").read_bytes() == b"1"


def test_claims_that_are_covered_are_not_written(spark, at):
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, rev long")
    for some, lines in (([(1, 5), (1, 3), (2, 7)], 2), ([(1, 5), (2, 6)], 2), ([(2, 8), (3, -1)], 4)):
        files.append_claims(frame(*some), f"{at}/log")
        assert spark.read.text(f"{at}/log").count() == lines
    assert sorted(tuple(r) for r in files.claims(spark, f"{at}/log").collect()) == [(1, 5), (2, 8), (3, -1)]


def test_results_are_not_written_over_files_or_into_mounts(tmp_path):
    (tmp_path / "mount").mkdir()
    (tmp_path / "out").mkdir()
    place = lambda *p: str(tmp_path.joinpath(*p))
    files.write_out(b"1", place("out", "f"), [place("mount")])
    with pytest.raises(FileExistsError):
        files.write_out(b"2", place("out", "f"), [])
    files.write_out(b"2", place("out", "f"), [], force=True)
    assert (tmp_path / "out" / "f").read_bytes() == b"2" and os.listdir(place("out")) == ["f"]
    os.symlink(place("out", "f"), place("out", "link"))
    os.symlink(place("mount"), place("out", "inside"))
    for bad, error in ((place("out", "link"), PermissionError), (place("mount", "f"), PermissionError), (place("out", "inside", "f"), PermissionError), (place("none", "f"), NotADirectoryError), (place("out"), PermissionError)):
        with pytest.raises(error):
            files.write_out(b"3", bad, [place("mount")], force=True)


def test_mount_file(spark):
    text = 'server = "https://s"\n[[mount]]\nworkspace = "w1"\nname = "N"\n[[mount]]\nworkspace = "w2"\nfolder = "a/b"\ndir = "d"\n'
    assert [tuple(r) for r in files.mount_table(spark, text).collect()] == [("w1", "N", "", None, "https://s"), ("w2", None, "d", "a/b", "https://s")]
    for bad in ("server = ", "[[mount]]\nworkspace = 'x'", "server = 's'\n[[mount]]\nname = 'x'"):
        with pytest.raises(ValueError):
            files.mount_table(spark, bad)


def test_missing_claim_log_is_empty(spark, at):
    assert files.claims(spark, f"{at}/none").count() == 0


def test_parked_is_told_before_not_held(spark):
    targets = spark.createDataFrame([(1, "m", None, " .//p.md "), (2, "m", 5, None), (3, "m", 6, None), (4, "m", None, "q.md"), (5, "m", 7, None)], "target long, mount string, id long, path string")
    mounts = spark.createDataFrame([("m", "ours", "present")], "mount string, identity string, state string")
    nodes = spark.createDataFrame([("m", 7, "n.md", "note")], "mount string, id long, path string, kind string")
    parks = spark.createDataFrame([("m", 5, "p.md")], "mount string, id long, path string")
    ledger, gone = spark.createDataFrame([("m", 6), ("m", 5)], "mount string, id long"), spark.createDataFrame([("m", 7, "unreadable")], "mount string, id long, fact string")
    got = {r["target"]: r["outcome"] for r in reading.locate(targets, mounts, nodes, parks, ledger, gone).collect()}
    assert got == {1: "parked", 2: "parked", 3: "ledger_only", 4: "not_held", 5: "unreadable"}


def test_reconciliation_goes_by_id_and_folded_path(spark):
    server = spark.createDataFrame([(1, "file", "New.md", "d1"), (2, "file", "É.md", "d2"), (3, "canvas", "x", None), (4, "file", "no-note.txt", "d4")], "id long, kind string, path string, digest string")
    disk = spark.createDataFrame([("new.md", False, "d1"), ("É.md", False, "d2")], "path string, is_folder boolean, digest string")
    state = spark.createDataFrame([(1, "note", "old.md", None), (2, "note", "É.md", None), (9, "note", "gone.md", None)], "id long, kind string, local_path string, marker_path string")
    got = sorted((r["class"], r["path"], r["id"]) for r in reconcile.reconcile(server, disk, state, server.select("id", "path").limit(0)).collect())
    assert got == [("state-orphan", "gone.md", 9), ("untracked", "New.md", 1)]


def test_reconciliation_prefers_the_very_path_and_knows_attachments(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    server = frame("id long, kind string, path string, digest string", (1, "file", "n.md", "d1"), (2, "file", "b.md", "d2"), (3, "file", "c.md", "d3"), (4, "attachment", "p.bin", "m4"), (5, "folder", "Dir", None), (6, "folder", "dir", None), (7, "file", 'q".md', "d7"))
    disk = frame("path string, is_folder boolean, digest string", ("N.MD", False, "other"), ("n.md", False, "d1"), ("b.md", False, "d2"), ("C.md", False, "x"), ("c.MD", False, "d3"), ("P.bin.ctl", False, "m4"), ("p.bin", False, "s"), ("dir", True, None), ('q".md', False, "d7"), ("q%22.md", False, "d7"))
    state = frame("id long, kind string, local_path string, marker_path string", (1, "note", "n.md", None), (9, "attachment", "b.md", "m/b.ctl"), (3, "note", "c.md", None), (4, "attachment", "p.bin", "p.bin.ctl"), (6, "folder", "dir", None), (7, "note", "q%22.md", None))
    none = server.select("id", "path").limit(0)
    got = lambda **how: sorted((r["class"], r["path"], r["id"]) for r in reconcile.reconcile(server, disk, state, none, **how).collect())
    shared = [("digest-mismatch", "c.md", 3), ("fold-collision", "Dir", 5), ("id-mismatch", "b.md", 2), ("missing-remote", "p.bin", None), ("state-orphan", "b.md", 9), ("untracked", "Dir", 5)]
    assert got() == sorted([*shared, ("missing-remote", "q%22.md", None), ("untracked", 'q".md', 7)])
    assert got(windows=True) == sorted([*shared, ("missing-remote", 'q".md', None)])


def test_redelivery(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    deliveries = frame("id long, path string, sha string", *[(i, f"p{i}", "new") for i in range(1, 9)])
    disk = frame("path string, sha string", ("p2", "new"), ("p3", "x"), ("p4", "old"), ("p5", "x"), ("p6", "x"), ("p7", "x"), ("p8", "new"))
    state = frame("id long, path string, sha string", (4, "p4", "old"), (5, "p5", "old"), (6, "p6", ""), (90, "P7", "y"), (8, "p8", "old"))
    got = {r["id"]: r["outcome"] for r in changes.redelivery(deliveries, disk, state).collect()}
    assert got == {1: "write", 2: "adopt", 3: "park_transient", 4: "overwrite", 5: "overwrite_edit", 6: "overwrite", 7: "overwrite", 8: "overwrite"}
    assert {r["id"]: r["outcome"] for r in changes.redelivery(deliveries, disk, state, frame("path string", ("p3",))).collect()}[3] == "overwrite"


def test_overlapping_mounts_by_geometry(spark):
    mounts = spark.createDataFrame([("a", "M/x"), ("b", "./m//X/y"), ("c", "m/xx"), ("d", "n")], "name string, dir string")
    assert [tuple(r) for r in reconcile.overlapping_mounts(mounts).collect()] == [("a", "b")]
    assert reconcile.overlapping_mounts(mounts, ignore_case=False).count() == 0


def test_settled_removals_and_first_claimants(spark):
    pending, tracked = spark.createDataFrame([("A/b",), ("c",)], "path string"), spark.createDataFrame([("a/B",)], "path string")
    assert [r["path"] for r in changes.settle_removals(pending, tracked).collect()] == ["c"]
    more = pending.union(spark.createDataFrame([("",), ("../x",), ("d",), ("e",), ("c",)], "path string"))
    disk = spark.createDataFrame([("c", True), ("e", False), ("A/b", True)], "path string, is_folder boolean")
    assert sorted(r["path"] for r in changes.settle_removals(more, tracked).collect()) == ["c", "d", "e"]
    assert [r["path"] for r in changes.settle_removals(more, tracked, disk).collect()] == ["c"]
    rows = spark.createDataFrame([(1, "É", 9), (2, "é", 1), (3, "e", 1)], "id long, path string, seq long")
    got = {r["id"]: r["holder"] for r in changes.first_claimants(rows, rows.filter("id = 1")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    class Cluster:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://x"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            scratch.new_path(Cluster, "x")


def test_overlapping_mounts_meet_once_a_name(spark, monkeypatch):
    """Names that are mounted many times, in one folder and below it, are joined once; folders of many names are dealt to several tasks."""
    monkeypatch.setattr(reconcile, "MOUNTS_A_SALT", 2)
    rows = [(f"n{i % 7}", d) for i in range(140) for d in ("m/a", f"m/a/{i}", f"k{i}")] + [("x", "m"), ("y", "m"), ("z", "M/A/3"), ("z", "other")]
    wanted = {tuple(sorted((p, q))) for p, d in rows for q, e in rows if p != q and (e.lower() == d.lower() or e.lower().startswith(d.lower() + "/"))}
    made = reconcile.overlapping_mounts(spark.createDataFrame(rows, "name string, dir string"))
    assert sorted(map(tuple, made.collect())) == sorted(wanted)
    many = spark.range(100_000).selectExpr("concat('n', id % 3) name", "'m' dir")  # joined row by row these are ten thousand million pairs
    assert sorted(map(tuple, reconcile.overlapping_mounts(many).collect())) == [("n0", "n1"), ("n0", "n2"), ("n1", "n2")]
