"""Queries of mounts, of written and read states and logs, and of the sync of a mirror."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import changes, mounts, reconcile
from tarn.plans.registry import query
from tarn.sources import files, pull, scratch, tables
from tarn.sources.scratch import new_path, store
from tarn.sources.tables import with_sql
from tarn.streaming import claims, pages, replay

# --- mounts ----------------------------------------------------------------------------------------------------------

CONFIG = """m AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'ws-1' ELSE 'ws-' || s_suppkey END AS workspace, CASE WHEN s_suppkey % 9 = 0 THEN 'a' || chr(7) WHEN s_suppkey % 8 = 0 THEN ' ' WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS name,
    CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'd/' || s_suppkey END AS dir, CASE WHEN s_suppkey % 6 = 0 THEN 'a/../b' WHEN s_suppkey % 5 = 0 THEN '/a/' WHEN s_suppkey % 4 = 0 THEN 'a/b c' END AS scope FROM supplier)"""


def _mounts(s, d):
    k = F.col("s_suppkey")
    text = k.cast("string")
    return tables.table(s, d, "supplier").select(
        F.when(k % 10 == 0, "ws-1").otherwise(F.concat(F.lit("ws-"), text)).alias("workspace"), F.when(k % 9 == 0, "a\x07").when(k % 8 == 0, " ").when(k % 7 == 0, None).otherwise(F.col("s_name")).alias("name"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("d/"), text)).alias("dir"), F.when(k % 6 == 0, "a/../b").when(k % 5 == 0, "/a/").when(k % 4 == 0, "a/b c").alias("scope"),
    )


@query(f"""WITH {CONFIG}, p AS (SELECT workspace, CASE WHEN contains(coalesce(name, ''), chr(7)) THEN 'control_character' WHEN trim(coalesce(name, dir)) = '' THEN 'blank_label'
    WHEN count(*) OVER (PARTITION BY workspace) > 1 THEN 'mounted_twice' WHEN scope IN ('a/../b', '/a/') THEN 'bad_scope' END AS problem FROM m) SELECT * FROM p WHERE problem IS NOT NULL""")  # fmt: skip
def config_problems(s, d):
    return mounts.config_problems(_mounts(s, d))


@query(f"""WITH {CONFIG} SELECT workspace, scope, CASE WHEN dir <> '' THEN dir WHEN scope IS NULL THEN workspace ELSE workspace || '@' || replace(trim(scope, '/'), '/', '-') END AS dir, dir = '' AS derived FROM m""")
def mount_directories(s, d):
    return mounts.with_directories(_mounts(s, d)).select("workspace", "scope", "dir", "derived")


STATUS = """m AS (SELECT s_name AS mount, s_suppkey AS workspace, 'd' || s_suppkey AS dir, CASE WHEN s_suppkey % 3 = 0 THEN 'a' END AS scope FROM supplier),
  st AS (SELECT s_suppkey AS workspace, s_suppkey % 4 AS nodes, s_suppkey % 2 AS parks, s_suppkey % 11 = 0 AS from_zero, s_suppkey % 13 <> 0 AS at_head, 0 AS transient_parks, CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END AS pending_removals,
    CASE WHEN s_suppkey % 3 = 0 THEN 'a' WHEN s_suppkey % 19 = 0 THEN 'b' END AS scope_key, s_suppkey * 10 AS head FROM supplier WHERE s_suppkey % 5 <> 0),
  fo AS (SELECT 'd' || s_suppkey AS dir, s_suppkey % 3 AS entries, CASE s_suppkey % 7 WHEN 0 THEN 'held' WHEN 1 THEN 'foreign' WHEN 2 THEN 'unreadable' ELSE 'ours' END AS identity FROM supplier WHERE s_suppkey % 8 <> 0),
  r AS (SELECT mount, workspace, nodes, coalesce(at_head, FALSE) AS at_head, coalesce(parks, 0) AS parks, CASE WHEN head IS NOT NULL THEN greatest(500 - head, 0) END AS head_age, entries IS NOT NULL AS exists_on_disk, coalesce(identity = 'ours', FALSE) AS claimed,
      coalesce(identity = 'held', FALSE) AS busy, coalesce(identity = 'unreadable', FALSE) AS unreadable, coalesce(nodes > 0, FALSE) AND coalesce(entries = 0, FALSE) AS emptied,
      coalesce(from_zero OR NOT at_head OR transient_parks > 0 OR pending_removals > 0 OR scope_key IS DISTINCT FROM scope, FALSE) AS incomplete, st.workspace IS NOT NULL AS has FROM m LEFT JOIN st USING (workspace) LEFT JOIN fo USING (dir)),
  q AS (SELECT * EXCLUDE (incomplete, has), has AND incomplete AS incomplete FROM r)"""
DEGRADED = "incomplete OR NOT exists_on_disk OR nodes IS NULL OR emptied OR (NOT claimed AND NOT busy)"


def _status(s, d):
    k = F.col("s_suppkey")
    rows, dir_ = tables.table(s, d, "supplier"), F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("dir")
    places = rows.select(F.col("s_name").alias("mount"), k.alias("workspace"), dir_, F.when(k % 3 == 0, "a").alias("scope"), F.lit(500).alias("now"))
    state = rows.filter("s_suppkey % 5 <> 0").select(
        k.alias("workspace"), (k % 4).alias("nodes"), (k % 2).alias("parks"), (k % 11 == 0).alias("from_zero"), (k % 13 != 0).alias("at_head"), F.lit(0).alias("transient_parks"),
        F.when(k % 17 == 0, 1).otherwise(0).alias("pending_removals"), F.when(k % 3 == 0, "a").when(k % 19 == 0, "b").alias("scope_key"), (k * 10).alias("head_reached_at"),
    )
    n = k % 7
    folders = rows.filter("s_suppkey % 8 <> 0").select(dir_, (k % 3).alias("entries"), F.when(n == 0, "held").when(n == 1, "foreign").when(n == 2, "unreadable").otherwise("ours").alias("identity"))
    return mounts.status(places, state, folders)


@query(f"""WITH {STATUS} SELECT *, {DEGRADED} AS degraded, CASE WHEN NOT exists_on_disk THEN 'not_built' WHEN emptied THEN 'empty' WHEN busy THEN 'held' WHEN unreadable THEN 'marker_unreadable' WHEN NOT claimed THEN 'not_this_mirror' END AS cache FROM q""")
def mount_status(s, d):
    return _status(s, d).withColumn("degraded", mounts.degraded()).withColumn("cache", mounts.cache_label())


@query(f"WITH {STATUS} SELECT bool_or({DEGRADED}) AS degraded, bool_or(busy) AS busy FROM q")
def status_flags(s, d):
    return mounts.flags(_status(s, d))


@query("""SELECT n_nationkey AS id, 'h' || n_nationkey AS handle, n_name AS name, n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AS mounted, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AND n_nationkey % 4 <> 0 THEN 'd' || n_nationkey END AS mounted_at,
    CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'sc' END AS scope FROM nation""")  # fmt: skip
def mount_listing(s, d):
    k = F.col("n_nationkey")
    rows = tables.table(s, d, "nation")
    places = rows.filter("n_nationkey % 3 = 0").select(k.alias("workspace"), F.concat(F.lit("d"), k.cast("string")).alias("dir"), (k % 4 == 0).alias("derived"), F.lit("sc").alias("scope"), F.when(k % 2 == 0, "https://s/").otherwise("https://other").alias("server"))
    return mounts.listing(rows.select(k.alias("id"), F.concat(F.lit("h"), k.cast("string")).alias("handle"), F.col("n_name").alias("name")), places, "https://s")


@query("""WITH n AS (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey) AS place, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 40 AS piece FROM customer)
    SELECT c_nationkey AS workspace, place, piece, list(c_acctbal ORDER BY c_custkey) AS ids FROM n GROUP BY 1, 2, 3""")
def calls_by_workspace(s, d):
    return mounts.calls(tables.table(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("workspace"), F.col("c_acctbal").alias("id")), 40)


@query("""WITH m AS (SELECT s_name AS mount, CASE s_suppkey % 5 WHEN 0 THEN 'no-access' WHEN 1 THEN 'not-entitled' ELSE 'ok' END AS access, s_suppkey % 3 <> 0 AS has_state, s_suppkey % 7 = 0 AS from_zero, s_suppkey % 4 <> 0 AS at_head FROM supplier)
    SELECT mount, access AS class FROM m WHERE access <> 'ok' UNION ALL SELECT mount, 'state-missing' FROM m WHERE access = 'ok' AND NOT has_state
    UNION ALL SELECT mount, 'repair-pending' FROM m WHERE access = 'ok' AND (NOT has_state OR from_zero OR NOT at_head)""")  # fmt: skip
def mount_findings(s, d):
    k = F.col("s_suppkey")
    access = F.when(k % 5 == 0, "no-access").when(k % 5 == 1, "not-entitled").otherwise("ok")
    return reconcile.mount_findings(tables.table(s, d, "supplier").select(F.col("s_name").alias("mount"), access.alias("access"), (k % 3 != 0).alias("has_state"), (k % 7 == 0).alias("from_zero"), (k % 4 != 0).alias("at_head")))


@query("SELECT DISTINCT source || '/' || lang AS path, 1 AS depth FROM documents UNION SELECT DISTINCT source, 0 FROM documents")
def deepest_first(s, d):
    docs = tables.table(s, d, "documents")
    return reconcile.deepest_first(docs.select(F.concat_ws("/", "source", "lang").alias("path")).union(docs.select("source")).distinct())


# --- replay ----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS class, count(*) AS n FROM events GROUP BY event_type")
def park_counts(s, d):
    return changes.park_counts(tables.table(s, d, "events").select(F.col("event_type").alias("class")))


@query("""WITH p AS (SELECT DISTINCT CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_type || '/' || p_size END AS path FROM part), t AS (SELECT DISTINCT lower(p_type || '/' || p_size) AS k FROM part WHERE p_partkey % 4 = 0),
    d AS (SELECT DISTINCT p_type || '/' || p_size AS path FROM part WHERE p_partkey % 3 <> 0)
    SELECT path FROM p WHERE path <> '' AND lower(path) NOT IN (SELECT k FROM t) AND path IN (SELECT path FROM d)""")
def settle_removals(s, d):
    """Folders that are owed a removal: some claimed again in another letter case, some gone from the disk, one blank."""
    rows = tables.table(s, d, "part").withColumn("path", F.concat_ws("/", "p_type", F.col("p_size").cast("string")))
    pending = rows.select(F.when(F.col("p_partkey") % 37 == 0, "").otherwise(F.col("path")).alias("path"))
    return changes.settle_removals(pending, rows.filter("p_partkey % 4 = 0").select(F.upper("path").alias("path")), rows.filter("p_partkey % 3 <> 0").select("path", F.lit(True).alias("is_folder")))


@query(with_sql("dn", """SELECT id, path, CASE WHEN id % 7 = 0 THEN 'write' WHEN id % 3 = 1 AND id % 5 > 1 THEN 'overwrite_edit' WHEN id % 3 <> 0 OR id % 11 = 0 THEN 'overwrite' WHEN id % 5 = 1 THEN 'adopt' ELSE 'park_transient' END AS outcome FROM dn WHERE live"""))
def redelivery(s, d):
    nodes = tables.doc_nodes(s, d)
    now = F.when(F.col("id") % 5 == 0, "old").when(F.col("id") % 5 == 1, "new").otherwise("edit")
    disk = nodes.filter("id % 7 <> 0").select("path", now.alias("sha"))
    # a third of the paths is tracked by the delivered node itself, a third by another one, in another letter case; some are vacated
    own, other = nodes.filter("id % 3 = 1").select("id", "path", F.lit("old").alias("sha")), nodes.filter("id % 3 = 2").select(F.col("id") + 10_000_000, F.upper("path"), F.lit("else"))
    return changes.redelivery(nodes.filter("live").select("id", "path", F.lit("new").alias("sha")), disk, own.union(other), nodes.filter("id % 11 = 0").select("path"))


@query("""WITH k AS (SELECT s_suppkey AS mount FROM supplier), n AS (SELECT c_nationkey AS mount, bool_or(c_custkey % 10 = 0) AS named, bool_or(c_custkey % 3 = 0 OR c_custkey % 2 = 1) AS gone FROM customer GROUP BY 1)
    SELECT mount, CASE WHEN mount % 3 = 0 THEN 'from_zero' WHEN mount % 5 = 0 THEN 'scope_changed' WHEN mount % 7 = 0 THEN 'no_head' WHEN named THEN 'instruction_name' WHEN gone THEN 'gone' END AS reason FROM k LEFT JOIN n USING (mount)""")  # fmt: skip
def invalidator(s, d):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    places = tables.table(s, d, "supplier").select(k.alias("mount"), F.lit("sc").alias("scope"), (k % 3 == 0).alias("from_zero"), F.when(k % 5 == 0, "other").otherwise("sc").alias("scope_key"), F.when(k % 7 != 0, 100).alias("head_reached_at"), F.lit(200).alias("now"))
    rows = tables.table(s, d, "customer").select(
        F.col("c_nationkey").alias("mount"), F.when(c % 2 == 0, "note").otherwise("folder").alias("kind"), F.concat(F.lit("sc/"), F.when(c % 10 == 0, "agents.MD/").otherwise(""), c.cast("string")).alias("path"), c.cast("string").alias("at"),
    )
    disk = rows.filter("cast(at as long) % 3 <> 0").select("mount", "at", F.lit(False).alias("is_folder"))
    return changes.invalidator(places, rows, disk)


@query(with_sql("cl", "SELECT id, max(rev) AS rev FROM cl GROUP BY id"))
def claim_log(s, d):
    """Claims appended to a log in two goes and once more, which adds nothing, with garbled lines between, and read back."""
    path = new_path(s, "claims")
    log = tables.changelog(s, d).select("id", "rev")
    files.append_claims(log.filter("rev % 2 = 0"), path)
    files.append_claims(log.filter("rev % 2 = 0"), path)
    assert s.read.text(path).count() == log.filter("rev % 2 = 0").select("id").distinct().count()
    log.select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" 9999999 1")).alias("value")).write.mode("append").text(path)
    files.append_claims(log.filter("rev % 2 = 1"), path)
    return files.claims(s, path)


@query("SELECT n_nationkey || '' AS id, 'h' || n_nationkey AS handle, n_name || '�' AS name FROM nation WHERE n_nationkey % 5 <> 0")
def workspace_scan(s, d):
    """Workspaces from JSON lines of which some are malformed and some have no id."""
    k = F.col("n_nationkey").cast("string")
    good = F.to_json(F.struct(F.when(F.col("n_nationkey") % 10 != 0, k).alias("id"), F.concat(F.lit("h"), k).alias("handle"), F.concat("n_name", F.lit("\x07")).alias("name")))
    path = new_path(s, "workspaces")
    tables.table(s, d, "nation").select(F.when(F.col("n_nationkey") % 10 == 5, F.lit('{"id": ')).otherwise(good).alias("value")).write.text(path)
    return files.workspaces(s, path)


@query(with_sql("cl lt", "SELECT id, rev, trashed, stamp, kind FROM lt WHERE kind <> 'view'"))
def saved_state(s, d):
    """A state that is saved twice and loaded; the first one is gone."""
    last = changes.latest(tables.changelog(s, d))
    saved = files.SavedTable(s, new_path(s, "state"))
    saved.save(last)
    saved.save(last.filter("kind <> 'view'"), {"epoch": 1, "cursor": 5})
    assert saved.load_cache({"epoch": 1, "cursor": 6}) is None
    gone = files.SavedTable(s, new_path(s, "cache"))
    gone.save(last.limit(1), {"epoch": 1})
    gone.clear()
    assert gone.load() is None
    return saved.load()


@query("""WITH f AS (SELECT r_name || '/' || n_name || '.md' AS path, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS body FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT path, FALSE AS is_folder, sha256(body) AS digest FROM f UNION ALL SELECT DISTINCT split_part(path, '/', 1), TRUE, NULL FROM f""")  # fmt: skip
def mirror_walk(s, d):
    """A mirror of small notes, some of them empty, written by tasks and walked again."""
    regions = tables.table(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    notes = tables.table(s, d, "nation").join(regions, "n_regionkey").select(F.concat("r_name", F.lit("/"), "n_name", F.lit(".md")).alias("path"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("content"))
    root = new_path(s, "mirror")
    files.write_files(notes.unionByName(s.createDataFrame([("MOUNT", "m")], "path string, content string")), root)
    return files.mirror(s, root, ("MOUNT",))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS content FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def blob_fetch(s, d):
    """Attachments by id: those that suppliers name."""
    root = new_path(s, "blobs")
    rows = tables.table(s, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".png").otherwise("")).alias("path"), F.col("n_name").alias("content"))
    files.write_files(rows, root)
    found = files.blobs(s, root, tables.table(s, d, "supplier").select(F.col("s_nationkey").alias("id")))
    return found.select("id", F.col("content").cast("string").alias("content"))


@query("SELECT r_regionkey || chr(9) || r_name || '�' || chr(9) AS line, '{\"regionKey\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS json FROM region")
def result_lines(s, d):
    rows = tables.table(s, d, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("gone"))
    lines = files.to_lines(rows.withColumn("name", F.concat("name", F.lit("\x00")))).select(F.split("value", "\t")[0].alias("k"), F.col("value").alias("line"))
    return lines.join(files.to_json_lines(rows).select(F.regexp_extract("value", r"\d+", 0).alias("k"), F.col("value").alias("json")), "k").select("line", "json")


@query(with_sql("cl lt", "SELECT id, rev, trashed, stamp, kind FROM lt WHERE id % 9 <> 4"))
def sync_two_passes(s, d):
    """A mirror built from the first half of the log, then synced with a log in which some nodes were deleted without a trace: the count
    tells, and the second pass rebuilds."""
    log = store(tables.changelog(s, d))
    middle = log.agg((F.max("rev") / 2).cast("long")).first()[0]
    live = lambda rows: changes.latest_live(rows).count()
    mirror = replay.Mirror(s, new_path(s, "mirror"), log.schema, parts=8)
    first = log.filter(F.col("rev") <= middle)
    mirror.sync(replay.Served(first, 1, live(first)), 100)
    left = log.filter("id % 9 <> 4")
    position = mirror.sync(replay.Served(left, 1, live(left)), 200)
    assert position.at_head and not position.from_zero
    return mirror.state()


@query(with_sql("cl", "SELECT id, rev, (row_number() OVER (ORDER BY rev, id) - 1) // 500 AS page FROM cl WHERE (rev, id) > (0, 0)"))
def pull_pages(s, d):
    """The log published and pulled by key in pages of 500, many of them a micro-batch; each page is a partition."""
    log, out, wide = tables.changelog(s, d).select("rev", "id", "kind"), new_path(s, "pulled"), pull.WIDE
    path = new_path(s, "log")
    pull.publish(log, path, 1, None)

    def step(rows, number):
        rows.select("id", "rev", (F.spark_partition_id() + number * wide).cast("long").alias("page")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    pull.collected_pages(pull.pull(s, path, pages=wide), new_path(s, "checkpoint"), step)
    return s.read.schema("id long, rev long, page long").parquet(*[f"{out}/batch={n}" for n in range(_batches(s, out))])


def _batches(s, out):
    return len(scratch.names_in(s, out))


LANGS = ("de", "en", "es", "fr")
#: Documents as a log: created; a fifth trashed and a seventh moved; a nineteenth given a twin in another letter case; the folders of one language trashed.
NODE_LOG = """d AS (SELECT doc_id AS i, source, lang, source || '/' || lang || '/' || doc_id AS base FROM documents),
    f AS (SELECT DISTINCT -(CAST(substr(source, 4) AS BIGINT) * 10 + list_position(['de', 'en', 'es', 'fr'], lang)) AS id, source || '/' || lang AS path, lang FROM documents),
    l AS (SELECT i AS id, i + 1 AS rev, CASE WHEN i % 13 = 0 THEN 'attachment' ELSE 'file' END AS kind, base || CASE WHEN i % 13 = 0 THEN '.bin' WHEN i % 11 = 0 THEN '.txt' ELSE '.md' END AS path, FALSE AS trashed FROM d
      UNION ALL SELECT i, 1000000000 + i, CASE WHEN i % 13 = 0 THEN 'attachment' ELSE 'file' END, CASE WHEN i % 5 = 0 THEN base || '.md' ELSE 'moved/' || i || '.md' END, i % 5 = 0 FROM d WHERE i % 5 = 0 OR i % 7 = 0
      UNION ALL SELECT i + 5000000000, 2000000000 + i, 'file', upper(source) || '/' || lang || '/' || i || '.MD', FALSE FROM d WHERE i % 19 = 0
      UNION ALL SELECT id, 1, 'folder', path, FALSE FROM f UNION ALL SELECT id, 3000000000, 'folder', path, TRUE FROM f WHERE lang = 'es')"""


@query(f"""WITH {NODE_LOG}, t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY rev DESC) = 1),
    k AS (SELECT id, CASE WHEN kind = 'attachment' THEN path || '.ctl' ELSE path END AS place, lower(path) AS fold, kind = 'file' AND path LIKE '%.txt' AS bad FROM t WHERE NOT trashed),
    n AS (SELECT k.id, k.place, bad, k.id >= 5000000000 AND EXISTS (SELECT 1 FROM k o WHERE o.fold = k.fold AND o.id < k.id AND NOT o.bad) AS twin FROM k)
    SELECT 'node' AS part, id, place AS text FROM n WHERE NOT bad AND NOT twin UNION ALL SELECT 'park', id, CASE WHEN bad THEN 'bad_note_name' ELSE 'fold' END FROM n WHERE bad OR twin
    UNION ALL SELECT 'debt', NULL, path FROM f WHERE lang = 'es' AND EXISTS (SELECT 1 FROM n WHERE NOT bad AND NOT twin AND starts_with(place, path || '/')) UNION ALL SELECT 'ledger', (SELECT count(*) FROM k), '' """)
def apply_pages(s, d):
    """A log of documents pulled page by page and applied to a mirror's books, to its head, and again when it has grown: what is tracked, parked
    and owed in the end, and the number of ids in the ledger."""
    docs = tables.table(s, d, "documents").select(F.col("doc_id").alias("i"), "source", "lang", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("base"))
    i, kind = F.col("i"), F.when(F.col("i") % 13 == 0, "attachment").otherwise("file")
    row = lambda id_, rev, kind, path, gone: [id_.cast("long").alias("id"), rev.cast("long").alias("rev"), kind.alias("kind"), path.alias("path"), gone.alias("trashed")]
    made = docs.select(*row(i, i + 1, kind, F.concat("base", F.when(i % 13 == 0, ".bin").when(i % 11 == 0, ".txt").otherwise(".md")), F.lit(False)))
    moved = F.when(i % 5 == 0, F.concat("base", F.lit(".md"))).otherwise(F.concat(F.lit("moved/"), i.cast("string"), F.lit(".md")))
    later = docs.filter("i % 5 = 0 or i % 7 = 0").select(*row(i, i + 10**9, kind, moved, i % 5 == 0))
    twin = F.concat(F.upper("source"), F.lit("/"), "lang", F.lit("/"), i.cast("string"), F.lit(".MD"))
    twins = docs.filter("i % 19 = 0").select(*row(i + 5 * 10**9, i + 2 * 10**9, F.lit("file"), twin, F.lit(False)))
    number = -(F.substring("source", 4, 9).cast("long") * 10 + F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")))
    place = docs.select("source", "lang").distinct()
    folders = place.select(*row(number, F.lit(1), F.lit("folder"), F.concat_ws("/", "source", "lang"), F.lit(False)))
    gone = place.filter("lang = 'es'").select(*row(number, F.lit(3 * 10**9), F.lit("folder"), F.concat_ws("/", "source", "lang"), F.lit(True)))
    filled = lambda rows: store(rows.withColumns({"sha": F.sha2("path", 256), "stamp": F.lit(None).cast("string")}))
    first, then = filled(made.union(folders)), filled(later.union(twins).union(gone))
    path, checkpoint, books = new_path(s, "log"), new_path(s, "checkpoint"), pages.Books(s, new_path(s, "books"))
    for new, every in ((first, first), (then, first.unionByName(then))):
        live = changes.latest_live(every).count()
        pull.publish(new, path, 1, live)
        assert pages.follow(books, path, checkpoint, pages.Riders(live), 1).at_head
    text = lambda name, value: books.read(name).select(F.lit(name[:-1]).alias("part"), "id", value.alias("text"))
    debts = books.read("debts").select(F.lit("debt").alias("part"), F.lit(None).cast("long").alias("id"), F.col("path").alias("text"))
    return text("nodes", F.col("place")).union(text("parks", F.col("reason"))).union(debts).union(books.read("ledger").agg(F.lit("ledger").alias("part"), F.count(F.lit(1)), F.lit("")))


@query(with_sql("cl", "SELECT id, max(rev) AS rev FROM cl GROUP BY id"))
def claim_stream(s, d):
    """The whole log as a stream of claims in four goes, each of which stops and is started again; the log of claims holds none twice."""
    rows = store(tables.changelog(s, d).select("id", "rev"))
    source, log, checkpoint = new_path(s, "claims"), new_path(s, "log"), new_path(s, "checkpoint")
    for k in range(4):
        rows.filter(F.col("rev") % 4 == k).write.mode("append").parquet(source)
        claims.follow(s, source, log, checkpoint)
    held = claims.appended(s, log)
    assert held.groupBy("id", "rev").count().filter("count > 1").isEmpty()
    return held.groupBy("id").agg(F.max("rev").alias("rev"))


@query(with_sql("cl lt", """, n AS (SELECT count(*) FILTER (NOT trashed) AS live FROM lt) SELECT step, verdict, CASE WHEN step = 'again' THEN 0 ELSE live END AS live FROM n,
    (VALUES ('head', 'fresh'), ('behind', 'behind'), ('parked', 'parked'), ('owed', 'pending_removals'), ('missed', 'missed_delete'), ('epoch', 'epoch_changed'), ('rollback', 'rolled_back'), ('again', 'fresh')) v(step, verdict)""").replace(" , n AS", ", n AS"))
def sync_verdicts(s, d):
    """A mirror of the whole log asked whether it is fresh, of servers that are ahead, of another epoch, that lost a node without a trace, or
    that were rolled back; and of one that is empty, after a rebuild."""
    log = store(tables.changelog(s, d))
    live = changes.latest_live(log).count()
    mirror = replay.Mirror(s, new_path(s, "mirror"), log.schema, parts=4)
    served = lambda rows=log, epoch=1, count=live: replay.Served(rows, epoch, count)
    mirror.sync(served(), 100)
    end = log.agg(F.max("rev")).first()[0]
    ahead = log.union(log.limit(1).withColumn("rev", F.lit(end + 1)))
    asked = [("head", mirror.check(served(), 101)[0]), ("behind", mirror.check(served(ahead), 102)[0])]
    asked += [("parked", mirror.check(served(), 103, transient_parks=1)[0]), ("owed", mirror.check(served(), 104, pending_removals=1)[0])]
    asked += [("missed", mirror.check(served(count=live - 1), 105)[0]), ("epoch", mirror.check(served(epoch=2), 106)[0])]
    try:
        mirror.check(served(count=None), 107)
        asked.append(("rollback", "none"))
    except replay.RolledBack:
        asked.append(("rollback", "rolled_back"))
    rows = s.createDataFrame(asked, "step string, verdict string").withColumn("live", F.lit(mirror.live().count()).cast("long"))
    empty = served(log.limit(0), 2, 0)
    mirror.sync(empty, 108)
    last = s.createDataFrame([("again", mirror.check(empty, 109)[0])], "step string, verdict string").withColumn("live", F.lit(mirror.live().count()).cast("long"))
    return rows.unionByName(last)


@query("SELECT 'ws-' || n_nationkey AS workspace, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'd/' || n_nationkey ELSE '' END AS dir, CASE WHEN n_nationkey % 5 = 0 THEN 'a b' END AS scope, 'https://s' AS server FROM nation")
def mount_file(s, d):
    """The mounts of a TOML text that is made of the nations."""
    rows = tables.table(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows; a mount file is small
    entry = lambda k, name: "[[mount]]\n" + "\n".join([f'workspace = "ws-{k}"', *([f'name = "{name}"'] if k % 3 == 0 else []), *([f'dir = "d/{k}"'] if k % 2 == 0 else []), *(['folder = "a b"'] if k % 5 == 0 else [])])
    return files.mount_table(s, 'server = "https://s"\n' + "\n".join(entry(*r) for r in rows))
