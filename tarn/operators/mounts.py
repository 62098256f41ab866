"""Mounts: configuration checks, default folders, status rows, listings of workspaces, calls by workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.operators import changes
from tarn.operators.graph import global_rank

_CONTROL = r"\p{Cc}"
_UUID = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?\z"


def default_directory(workspace: Column, scope: Column) -> Column:
    """A mount's own folder: its workspace, and @ and the scope with - for / where it has one, so two scopes never share one."""
    return F.when(scope.isNull(), workspace).otherwise(F.concat(workspace, F.lit("@"), F.replace(F.regexp_replace(scope, r"^/+|/+\z", ""), F.lit("/"), F.lit("-"))))


def with_directories(mounts: DataFrame) -> DataFrame:
    """mounts(workspace, scope, dir) with a blank dir replaced by the default one, and whether it was (derived)."""
    blank = F.coalesce(F.trim("dir"), F.lit("")) == ""
    return mounts.withColumn("derived", blank).withColumn("dir", F.when(blank, default_directory(F.col("workspace"), F.col("scope"))).otherwise(F.col("dir")))


def valid_scope(scope: Column) -> Column:
    """Whether a scope is a relative folder path of proper parts; a null one is no scope and valid."""
    bad = F.exists(rules.segments(scope), lambda x: x.isin("", ".", "..") | F.contains(x, F.lit("\\")) | F.rlike(x, F.lit(_CONTROL)) | (rules._strip(x) != x) | (F.octet_length(x) > 255))
    return scope.isNull() | ~bad


def config_problems(mounts: DataFrame) -> DataFrame:
    """(workspace, problem) of mounts(workspace, name, dir, scope), the first problem of each: control_character, blank_label,
    label_is_a_workspace (of another mount, so that one string would select two), mounted_twice, bad_scope."""
    label = F.trim(F.coalesce("name", "dir"))
    control = F.rlike("dir", F.lit(_CONTROL)) | F.coalesce(F.rlike("name", F.lit(_CONTROL)), F.lit(False))
    counted = mounts.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))
    others = mounts.select(F.lower("workspace").alias("label_key"), F.lit(True).alias("other")).distinct()
    rows = mounts.withColumn("label", label).withColumn("label_key", F.lower("label")).join(others, "label_key", "left").join(counted, "workspace")
    problem = (
        F.when(control, "control_character").when(F.col("label") == "", "blank_label").when(F.col("other") & (F.col("label_key") != F.lower("workspace")) & F.rlike("label", F.lit(_UUID)), "label_is_a_workspace")
        .when(F.col("n") > 1, "mounted_twice").when(~valid_scope(F.col("scope")), "bad_scope")
    )
    return rows.select("workspace", problem.alias("problem")).filter("problem is not null")


def status(mounts: DataFrame, state: DataFrame, folders: DataFrame) -> DataFrame:
    """One row a mount of mounts(mount, workspace, dir, scope, now): state(workspace, nodes, parks, from_zero, at_head, transient_parks,
    pending_removals, scope_key, head_reached_at) and folders(dir, entries, identity) are joined from the left."""
    held = state.withColumn("has_state", F.lit(True))
    rows = mounts.join(held, "workspace", "left").join(folders, "dir", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    exists = F.col("entries").isNotNull()
    return rows.select(
        "mount", "workspace", "nodes", yes(F.col("at_head")).alias("at_head"), yes(changes.incomplete() | ~F.col("scope_key").eqNullSafe(F.col("scope"))).alias("raw_incomplete"), yes(F.col("has_state")).alias("has_state"),
        F.coalesce("parks", F.lit(0)).alias("parks"), F.when(F.col("head_reached_at").isNotNull(), F.greatest(F.col("now") - F.col("head_reached_at"), F.lit(0))).alias("head_age"), exists.alias("exists_on_disk"),
        yes(F.col("identity") == "ours").alias("claimed"), yes(F.col("identity") == "held").alias("busy"), yes(F.col("identity") == "unreadable").alias("unreadable"),
        (yes(F.col("nodes") > 0) & yes(F.col("entries") == 0)).alias("emptied"),
    ).withColumn("incomplete", F.col("has_state") & F.col("raw_incomplete")).drop("raw_incomplete", "has_state")


def degraded() -> Column:
    """Whether a status row is degraded."""
    return F.col("incomplete") | ~F.col("exists_on_disk") | F.col("nodes").isNull() | F.col("emptied") | (~F.col("claimed") & ~F.col("busy"))


def cache_label() -> Column:
    """What a status row says of the mirror's folder; null where nothing is wrong."""
    return (
        F.when(~F.col("exists_on_disk"), "not_built").when(F.col("emptied"), "empty").when(F.col("busy"), "held").when(F.col("unreadable"), "marker_unreadable")
        .when(~F.col("claimed"), "not_this_mirror")
    )


def flags(rows: DataFrame) -> DataFrame:
    """One row of any() flags over status rows."""
    return rows.agg(F.coalesce(F.bool_or(degraded()), F.lit(False)).alias("degraded"), F.coalesce(F.bool_or("busy"), F.lit(False)).alias("busy"))


def listing(workspaces: DataFrame, mounts: DataFrame, server: str) -> DataFrame:
    """(id, handle, name, mounted, mounted_at, scope) of workspaces(id, handle, name): mounts(workspace, dir, derived, scope, server)
    of the same server only; a derived folder is not named."""
    here = mounts.filter(F.regexp_replace("server", r"/+\z", "") == server)
    here = here.select(F.col("workspace").alias("id"), F.lit(True).alias("m"), F.when(~F.col("derived"), F.col("dir")).alias("mounted_at"), "scope")
    return workspaces.join(here, "id", "left").select("id", "handle", "name", F.col("m").isNotNull().alias("mounted"), "mounted_at", "scope")


#: Ids that one row of a call holds.
CALL_IDS = 1000


def calls(reads: DataFrame, size: int = CALL_IDS) -> DataFrame:
    """(workspace, place, piece, ids) of reads(seq, workspace, id): ids in the order of arrival, in pieces of `size`; place: the first read of
    the workspace. A workspace with very many reads has many rows and is no single task's work: reads are ranked in one total order, and
    a workspace's own numbers begin where its reads do.
    """
    ranked = global_rank(reads.select("workspace", "seq", "id"), [F.col("workspace"), F.col("seq"), F.col("id")], "n")
    begins = ranked.groupBy("workspace").agg(F.min("n").alias("begin"), F.min("seq").alias("place"))
    rows = ranked.join(begins, "workspace").withColumn("piece", F.floor((F.col("n") - F.col("begin")) / size))
    grouped = rows.groupBy("workspace", "place", "piece").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("r"))
    return grouped.select("workspace", "place", "piece", F.col("r.id").alias("ids"))


def column_width(rows: DataFrame, column: str) -> DataFrame:
    """One row: the most characters of a column's values."""
    return rows.agg(F.coalesce(F.max(F.char_length(column)), F.lit(0)).alias("width"))
