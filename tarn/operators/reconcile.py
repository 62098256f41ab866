"""Three-way reconciliation of server, disk and recorded state, by folded path and by id, and checks between mounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.operators import changes
from tarn.sources.scratch import store

WRITE_TEMP_PREFIX = ".write-"


def _by_id(server: DataFrame, state: DataFrame, parks: DataFrame) -> DataFrame:
    """(id, served, held, parked): what the three sides say of an id, in one grouping."""
    sides = (
        server.select("id", F.struct("kind", "path", "digest").alias("served")),
        state.select("id", F.struct("kind", "local_path", "marker_path").alias("held")), parks.select("id", F.lit(True).alias("parked")),
    )
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[2], allowMissingColumns=True)
    return rows.groupBy("id").agg(F.max("served").alias("served"), F.max("held").alias("held"), F.max("parked").alias("parked"))


def _wanted(by_id: DataFrame, scope: str | None, ignore_case: bool, windows: bool) -> DataFrame:
    """(id, kind, path, fold_key, digest, held_at); held_at: where the state tracks the node."""
    rows = by_id.filter("served is not null and parked is null").select("id", "served.*", "held")
    path = F.col("path")
    local = rules.scope_relative(path, scope) if scope else path
    local = rules.encode_win_path(local) if windows else local
    fits = ~F.exists(rules.segments(local), lambda x: rules.component_units(x, windows) > 255)
    note_name = (F.col("kind") != "file") | rules.is_note_name(rules.leaf_of(path))
    wanted = changes.known_kind(F.col("kind")).isNotNull() & ~rules.has_reserved_segment(path) & ~rules.in_control_namespace(path) & (local != "") & note_name & fits
    want = F.when(F.col("kind") == "attachment", F.coalesce("held.marker_path", F.concat(local, F.lit(rules.CONTROL_SUFFIX)))).otherwise(local)
    held_at = F.when(F.col("held.kind") == "attachment", F.col("held.marker_path")).otherwise(F.col("held.local_path"))
    rows = rows.filter(wanted).select("id", changes.known_kind(F.col("kind")).alias("kind"), want.alias("path"), "digest", held_at.alias("held_at"))
    return rules.with_fold_key(store(rows), ignore_case=ignore_case).select("id", "kind", "path", "fold_key", "digest", "held_at")


def expectations(server: DataFrame, state: DataFrame, parks: DataFrame, scope: str | None = None, ignore_case: bool = True, windows: bool = False) -> DataFrame:
    """(id, kind, path, fold_key, digest): what server(id, kind, path, digest) wants on disk. Parked nodes want nothing, nor do nodes
    of unknown kinds, with reserved or control names, outside the scope, or whose names cannot be those of notes or of files; an
    attachment wants its marker, where state(id, kind, local_path, marker_path) has it or beside it. windows: names as Windows can
    spell them."""
    return _wanted(_by_id(server, state, parks), scope, ignore_case, windows).drop("held_at")


#: The classes of discrepancies between server, disk and state, in the order in which a node is tested.
CLASSES = ("missing-local", "digest-mismatch", "id-mismatch", "marker-drift", "untracked", "fold-collision", "crash-residue", "missing-remote", "state-orphan", "parked")


def reconcile(server: DataFrame, disk: DataFrame, state: DataFrame, parks: DataFrame, scope: str | None = None, ignore_case: bool = True, windows: bool = False) -> DataFrame:
    """(path, id, class): one row a discrepancy between server(id, kind, path, digest), disk(path, is_folder, digest) and
    state(id, kind, local_path, marker_path); parks(id, path). Digests of attachments are those of their markers. Markers that were
    moved to the control folder stand in `disk` under their path there. Ids are numbers.

    The three sides meet once by id, and once by place: facts of a path (what stands there, who is tracked there, attachments too) and of
    a folded path are reduced map-side to one row each before they are joined. What stands at the very path counts, else what stands at
    its folded key, of several the first by path.
    """
    by_id = store(_by_id(server, state, parks))
    wanted = store(_wanted(by_id, scope, ignore_case, windows))
    there = store(rules.with_fold_key(store(disk.select("path", "is_folder", "digest")), ignore_case=ignore_case))
    loose = ~F.coalesce(F.col("held_at") == F.col("path"), F.lit(False))
    seen = F.struct("is_folder", F.col("digest").alias("seen"))
    at_path = there.select("path", seen.alias("exact")).unionByName(state.select(F.col("local_path").alias("path"), F.col("id").alias("held_by")), allowMissingColumns=True)
    at_path = at_path.groupBy("path").agg(F.max("exact").alias("exact"), F.min("held_by").alias("held_by"))
    # of several nodes on one folded path the one that the state tracks at its path keeps it, else the first
    at_key = there.select("fold_key", F.struct("path", seen.alias("x")).alias("alike")).unionByName(wanted.select("fold_key", F.struct(loose.alias("loose"), "id").alias("keeper")), allowMissingColumns=True)
    at_key = store(at_key.groupBy("fold_key").agg(F.min("alike").alias("alike"), F.min("keeper").alias("keeper")))
    rows = wanted.join(at_path, "path", "left").join(at_key, "fold_key").withColumn("disk", F.coalesce("exact", "alike.x"))
    is_kind = lambda k: F.col("kind") == k
    present = F.coalesce(F.col("disk.is_folder") == is_kind("folder"), F.lit(False))
    differs = ~F.col("disk.seen").eqNullSafe(F.col("digest"))
    classes = F.array_compact(
        F.array(
            F.when(~present, "missing-local"), F.when(present & is_kind("note") & differs, "digest-mismatch"),
            F.when(present & is_kind("note") & (F.col("held_by") != F.col("id")), "id-mismatch"), F.when(present & is_kind("attachment") & differs, "marker-drift"),
            F.when(present & F.when(is_kind("note"), F.col("held_by").isNull()).when(is_kind("folder"), loose).otherwise(~differs & loose), "untracked"),
            F.when(F.col("id") != F.col("keeper.id"), "fold-collision"),
        )
    )
    found = rows.select("path", "id", F.explode(classes).alias("class"))
    left_over = rules.is_write_temp(rules.leaf_of(F.col("path")), WRITE_TEMP_PREFIX) & ~F.col("is_folder")
    strays = there.join(at_key.filter("keeper is not null").select("fold_key"), "fold_key", "left_anti").select("path", F.lit(None).cast("long").alias("id"), F.when(left_over, "crash-residue").otherwise("missing-remote").alias("class"))
    orphans = by_id.filter("served is null and held is not null").select(F.col("held.local_path").alias("path"), "id", F.lit("state-orphan").alias("class"))
    parked = parks.select("path", "id", F.lit("parked").alias("class"))
    return found.unionByName(strays).unionByName(orphans).unionByName(parked)


def mount_findings(mounts: DataFrame) -> DataFrame:
    """(mount, class) of mounts(mount, access, has_state, from_zero, at_head): one that may not be read has no further finding."""
    refused = F.col("access").isin("no-access", "not-entitled")
    pending = F.col("has_state") & (F.col("from_zero") | ~F.col("at_head")) | ~F.col("has_state")  # a fresh state begins from zero
    classes = F.when(refused, F.array("access")).otherwise(F.array_compact(F.array(F.when(~F.col("has_state"), "state-missing"), F.when(pending, "repair-pending"))))
    return mounts.select("mount", F.explode(classes).alias("class"))


def class_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def exit_code(found: DataFrame) -> DataFrame:
    """One row: how many discrepancies there are, and 1 if any, else 0."""
    return found.agg(F.count(F.lit(1)).alias("total")).select("total", F.when(F.col("total") > 0, 1).otherwise(0).alias("code"))


#: Names of one folder that one task joins.
MOUNTS_A_SALT = 2048


def overlapping_mounts(mounts: DataFrame, ignore_case: bool = True) -> DataFrame:
    """(a, b) of mounts(name, dir) whose folders, as geometry_key() has them, contain one another. Ancestors are exploded, so it is an
    equi-join; names are distinct on both sides of it, two in one folder meet once, and a folder of more than MOUNTS_A_SALT names is
    dealt to several tasks."""
    placed = store(rules.geometry_key(mounts.select("name", "dir"), ignore_case=ignore_case).select("name", F.col("key").alias("dir")).distinct())
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("dir"), "/"), 1, i), "/"))
    inner = placed.select(F.col("name").alias("inner_name"), F.col("dir").alias("own"), F.explode(up).alias("dir"))
    inner = inner.groupBy("inner_name", "dir").agg(F.min(F.col("own") == F.col("dir")).alias("level"))
    salts = placed.groupBy("dir").agg(F.ceil(F.count(F.lit(1)) / MOUNTS_A_SALT).cast("int").alias("salts"))
    outer = placed.join(salts, "dir").withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int")).drop("salts")
    inner = inner.join(salts, "dir").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = inner.join(outer, ["dir", "salt"]).filter((F.col("inner_name") < F.col("name")) | (~F.col("level") & (F.col("inner_name") != F.col("name"))))
    return pairs.select(F.least("name", "inner_name").alias("a"), F.greatest("name", "inner_name").alias("b")).distinct()


def severity(code: Column) -> Column:
    """How bad an exit code is: 2 over 4 over 3 over 1 over 0."""
    return F.when(code == 2, 4).when(code == 4, 3).when(code == 3, 2).when(code == 1, 1).otherwise(0)


def worst_exit(rows: DataFrame, *by: str) -> DataFrame:
    """The worst exit code of rows(code), for each group of the columns `by`."""
    return rows.groupBy(*by).agg(F.max_by("code", severity(F.col("code"))).alias("code"))


def deepest_first(folders: DataFrame) -> DataFrame:
    """folders(path) in an order in which they can be removed: the deepest first, then by path."""
    return folders.withColumn("depth", rules.depth_of(F.col("path"))).orderBy(F.desc("depth"), "path")
