"""Change-log replay in batch: latest rows, pages, ledger checks, classification, collisions, pruning, claims, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.operators.graph import global_rank
from tarn.sources.scratch import store

PAGE_ROWS = 500
HEAD_AGE_SECONDS = 30 * 86400
CLOCK_SKEW_SECONDS = 300
CHANGED_BUDGET = 512


def latest(changes: DataFrame) -> DataFrame:
    """The last row of each id; max_by is combined map-side, so a hot id moves one row a task."""
    rest = [c for c in changes.columns if c != "id"]
    return changes.groupBy("id").agg(F.max_by(F.struct(*rest), "rev").alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in rest))


def latest_live(changes: DataFrame) -> DataFrame:
    return latest(changes).filter("not trashed")


def after(changes: DataFrame, rev: int, id_: int) -> DataFrame:
    """Rows strictly after (rev, id)."""
    return changes.filter((F.col("rev") > rev) | ((F.col("rev") == rev) & (F.col("id") > id_)))


def keyset_page(changes: DataFrame, rev: int, id_: int, limit: int = PAGE_ROWS) -> DataFrame:
    """Rows strictly after (rev, id), in that order."""
    return after(changes, rev, id_).orderBy("rev", "id").limit(limit)


def page_index(changes: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    """Page number of every row in keyset order."""
    return global_rank(changes, [F.col("rev"), F.col("id")], "n").withColumn("page", F.floor((F.col("n") - 1) / size)).drop("n")


def is_head(rows: Column, limit: int = PAGE_ROWS) -> Column:
    return rows < limit


def ledger_check(live_nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: live count, ledger count, and whether a rebuild is due."""
    counts = live_nodes.agg(F.count(F.lit(1)).alias("live_nodes")).join(ledger.agg(F.count(F.lit(1)).alias("ledger")))  # one row each
    return counts.withColumn("rebuild", F.col("live_nodes") != F.col("ledger"))


def classify(rows: DataFrame, tracked: DataFrame, scope: str | None = None, max_component: int = 255, windows: bool = False) -> DataFrame:
    """(id, path, disposition, reason) of rows(id, kind, path, trashed): the first test that holds decides.

    A reserved segment is skipped (removed where it is tracked), not parked; names that agents read as instructions are looked
    for below the scope only, since only those land on disk; a part's length counts bytes, or under Windows rules the UTF-16 units
    of its spelling on disk.
    """
    path = F.col("path")
    local = rules.scope_relative(path, scope) if scope else path
    name = rules.leaf_of(path)
    projected = rules.encode_win_path(local) if windows else local
    long_part = F.exists(rules.segments(projected), lambda x: rules.component_units(x, windows) > max_component)
    reason = (
        F.when(F.col("trashed"), "trashed").when(known_kind(F.col("kind")).isNull(), "unknown_kind").when(rules.has_reserved_segment(path), "reserved")
        .when(rules.in_control_namespace(path), "control").when(local.isNull(), "out_of_scope").when(local == "", "scope_root").when(rules.names_instructions(local), "instruction_name")
        .when((F.col("kind") == "file") & ~rules.is_note_name(name), "bad_note_name").when(long_part, "unrepresentable")
    )
    marked = rows.join(tracked.select("id", F.lit(True).alias("held")).distinct(), "id", "left").withColumn("reason", reason)
    parks = F.col("reason").isin("control", "instruction_name", "bad_note_name", "unrepresentable")
    disposition = F.when(F.col("reason").isNull(), "put").when(parks, "park").when(F.col("held"), "remove").otherwise("ledger_only")
    return marked.select("id", "path", disposition.alias("disposition"), "reason")


def known_kind(kind: Column) -> Column:
    """note, folder or attachment; null for any other kind."""
    return F.when(kind == "file", "note").when(kind.isin("folder", "attachment"), kind)


def first_claimants(rows: DataFrame, incumbents: DataFrame) -> DataFrame:
    """(id, fold_key, holder) of rows(id, path, seq): incumbents(id) claim a folded key before others, then the order of seq decides.

    The first claimant is a minimum, which is combined map-side: a key that many rows claim moves one row a task.
    """
    keyed = store(rules.with_fold_key(rows.join(incumbents.select("id", F.lit(0).alias("newcomer")).distinct(), "id", "left")))
    first = F.min_by("id", F.struct(F.coalesce("newcomer", F.lit(1)), "seq", "id"))
    holders = keyed.groupBy("fold_key").agg(first.alias("holder"))
    return keyed.join(holders, "fold_key").select("id", "fold_key", "holder")


def _ancestors(path: str) -> Column:
    """All proper ancestors of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def collision_fixpoint(rows: DataFrame, incumbents: DataFrame | None = None, parks: DataFrame | None = None, fewest: int | None = None) -> DataFrame | None:
    """(id, path, park) of deliveries rows(id, path, seq, parked): which of them park, and why.

    Every round derives the parks anew from those of the round before, until they stay: a delivery parks as `ancestor` below the
    path of a parked delivery (one that came `parked`, or parked in the last round) or of a durable park(id, path); as
    `projection` if another node holds its very path, as `fold` if another holds its folded key. Incumbents(id, path) hold theirs
    before any delivery, unless they are delivered themselves; then deliveries that do not park hold theirs in the order of seq.
    With n deliveries there are n + 2 rounds at most, and the last one stands; a cycle of rounds is run once and counted on. Every
    round is a written table. fewest: rows are several sets, the smallest of so many deliveries; None is returned unless they stay as
    early as that one's rounds end.
    """
    base = store(rules.with_fold_key(rows.select("id", "path", "seq", "parked")))
    none, delivered = base.select("id", "path").limit(0), base.select("id")
    fixed = (parks if parks is not None else none).join(delivered, "id", "left_anti").select("path").union(base.filter("parked").select("path"))
    fixed = store(fixed.filter("path <> ''").distinct())
    held = store(rules.with_fold_key((incumbents if incumbents is not None else none).join(delivered, "id", "left_anti").select("id", "path")))
    held_keys, held_paths = held.select("fold_key", F.lit(True).alias("key_held")).distinct(), held.select("path", F.lit(True).alias("path_held")).distinct()
    puts = base.filter("not parked")
    puts = store(puts.join(held_keys, "fold_key", "left").join(held_paths, "path", "left"))
    above = store(puts.select("id", F.explode(_ancestors("path")).alias("path")))

    def derive(parked: DataFrame | None) -> DataFrame:
        prefixes = fixed if parked is None else fixed.union(puts.join(parked.select("id"), "id", "left_semi").select("path")).distinct()
        under = above.join(prefixes, "path", "left_semi").select("id").distinct()
        free = puts.join(under, "id", "left_anti")
        first = free.groupBy("fold_key").agg(F.min_by(F.struct("id", "path"), F.struct("seq", "id")).alias("first"))
        lost = free.join(first, "fold_key").filter(F.col("key_held") | (F.col("id") != F.col("first.id")))
        same = F.coalesce("path_held", F.lit(False)) | (F.col("key_held").isNull() & (F.col("path") == F.col("first.path")))
        return under.select("id", F.lit("ancestor").alias("park")).union(lost.select("id", F.when(same, "projection").otherwise("fold")))

    rounds, seen = base.count() + 2, {(0, None): 0}
    if fewest is not None:
        rounds = min(rounds, fewest + 3)  # the last of which shows that the one before stays
    history: list[DataFrame | None] = [None]
    for number in range(1, rounds + 1):
        history.append(store(derive(history[-1])))
        state = tuple(history[-1].agg(F.count(F.lit(1)), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first())
        if state in seen:
            start = seen[state]
            if start < number - 1 and fewest is not None:
                return None
            if start < number - 1:  # not stable but a cycle: the table that the last round would give
                return _parked(base, history[start + (rounds - start) % (number - start)])
            break
        seen[state] = number
    else:
        if fewest is not None:
            return None
    return _parked(base, history[-1])


def _parked(base: DataFrame, parks: DataFrame | None) -> DataFrame:
    if parks is None:
        return base.select("id", "path", F.when(F.col("parked"), "classified").alias("park"))
    return base.join(parks, "id", "left").select("id", "path", F.when(F.col("parked"), "classified").otherwise(F.col("park")).alias("park"))


def park_counts(parks: DataFrame) -> DataFrame:
    """(class, n) of parks(class)."""
    return parks.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def ledger(held: DataFrame, page: DataFrame) -> DataFrame:
    """(id): what a ledger(id) holds after a page(id, trashed) of one row an id: delivered ids join it, trashed ones leave it."""
    return held.select("id").union(page.filter("not trashed").select("id")).distinct().join(page.filter("trashed").select("id"), "id", "left_anti")


def prune(tracked: DataFrame, delivered: DataFrame) -> DataFrame:
    """Tracked ids that were not delivered."""
    return tracked.join(delivered.select("id"), "id", "left_anti")


def fold_claims(claims: DataFrame) -> DataFrame:
    """claims(id, rev): the largest revision of each id, in any order of arrival."""
    return claims.groupBy("id").agg(F.max("rev").alias("rev"))


def fire_claims(claims: DataFrame, state: DataFrame) -> DataFrame:
    """Claims newer than what is stored."""
    held = state.select("id", F.col("rev").alias("stored_rev"))
    return fold_claims(claims).join(held, "id").filter(F.col("rev") > F.col("stored_rev"))


def new_claims(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Claims that the held log does not cover yet: what an append writes."""
    return claims.join(held.select("id", F.col("rev").alias("h")), (claims["id"] == held["id"]) & (F.col("h") >= claims["rev"]), "left_anti")


def content_moved(stored: Column, served: Column) -> Column:
    return served.isNotNull() & ~stored.eqNullSafe(served)


def marks_from(changed: DataFrame, held: DataFrame, truncated: bool = False) -> DataFrame:
    """Claims from a changed set(id, rev, at, gone) against held notes(id, rev, stamp); a truncated set claims nothing."""
    known = held.select("id", F.col("rev").alias("held_rev"), "stamp")
    rows = changed.join(known, "id").filter((F.col("gone") | content_moved(F.col("stamp"), F.col("at"))) & (F.col("rev") > F.col("held_rev")))
    return rows.select("id", "rev").filter(F.lit(not truncated))


def changed_set(changes: DataFrame, rev: int, budget: int = CHANGED_BUDGET) -> DataFrame:
    """Latest rows above a cursor, or none at all if there are more than the budget."""
    above = latest(changes.filter(F.col("rev") > rev))
    few = above.agg((F.count(F.lit(1)) <= budget).alias("few"))
    return above.join(F.broadcast(few)).filter("few").select("id", "rev", F.col("trashed").alias("gone"))  # one row


def settle_removals(pending: DataFrame, tracked: DataFrame, disk: DataFrame | None = None) -> DataFrame:
    """What is still to be removed of pending(path): a path whose folded key a tracked(path) node claims again is no debt any more, nor is a
    blank one, which would be the root itself, nor one that leaves the root, nor, where disk(path, is_folder) is known, one that is no folder
    there."""
    claimed = rules.with_fold_key(tracked.select("path")).select("fold_key").distinct()
    owed = pending.select("path").filter((F.col("path") != "") & rules.lexical_contained(F.col("path"))).distinct()
    if disk is not None:
        owed = owed.join(disk.filter("is_folder").select("path").distinct(), "path", "left_semi")
    return rules.with_fold_key(owed).join(claimed, "fold_key", "left_anti").select("path")


def redelivery(deliveries: DataFrame, disk: DataFrame, state: DataFrame, vacated: DataFrame | None = None) -> DataFrame:
    """(id, path, outcome) of deliveries(id, path, sha) against disk(path, sha) and state(id, path, sha), what was last delivered.

    A path where nothing stands is written. One that some tracked node claims, or that was vacated(path) in this page, is overwritten;
    that loses an edit by hand if the node's last bytes are known and those on disk are neither them nor the incoming ones. Of a path
    that nobody claims, equal bytes are adopted, so that a delivery may come again, and others park for the time being.
    """
    claims = state.select("path") if vacated is None else state.select("path").union(vacated.select("path"))
    claimed = rules.with_fold_key(claims).select("fold_key", F.lit(True).alias("claimed")).distinct()
    own = state.select("id", F.nullif("sha", F.lit("")).alias("last_sha"))
    there = disk.select("path", F.col("sha").alias("disk_sha"))
    rows = rules.with_fold_key(deliveries).join(there, "path", "left").join(own, "id", "left").join(claimed, "fold_key", "left")
    same = F.col("disk_sha") == F.col("sha")
    edited = (F.col("disk_sha") != F.col("last_sha")) & ~same
    outcome = F.when(F.col("disk_sha").isNull(), "write").when(F.col("claimed") & edited, "overwrite_edit").when(F.col("claimed"), "overwrite").when(same, "adopt").otherwise("park_transient")
    return rows.select("id", "path", outcome.alias("outcome"))


def invalidator(mounts: DataFrame, nodes: DataFrame, disk: DataFrame) -> DataFrame:
    """(mount, reason) of mounts whose state cannot be trusted: mounts(mount, scope and the columns of rebuild_reason()), tracked
    nodes(mount, kind, path, at) and disk(mount, at, is_folder): a reason to rebuild, else `instruction_name` if a node is tracked below
    a name that agents read, else `gone` if something tracked is not on disk as what it is. `at` is where a node stands."""
    there = disk.select("mount", "at", "is_folder")
    inside = F.when(F.col("scope").isNull(), F.col("path")).when(F.startswith("path", F.concat("scope", F.lit("/"))), F.expr("substring(path, length(scope) + 2)"))
    rows = nodes.join(mounts.select("mount", "scope"), "mount").join(there, ["mount", "at"], "left")
    gone = ~F.coalesce(F.col("is_folder") == (F.col("kind") == "folder"), F.lit(False))
    found = rows.groupBy("mount").agg(F.bool_or(F.coalesce(rules.names_instructions(inside), F.lit(False))).alias("named"), F.bool_or(gone).alias("gone"))
    reason = F.when(rebuild_reason().isNotNull(), rebuild_reason()).when(F.col("named"), "instruction_name").when(F.col("gone"), "gone")
    return mounts.join(found, "mount", "left").select("mount", reason.alias("reason"))


def rebuild_reason() -> Column:
    """For columns from_zero, scope_key, scope, head_reached_at, now."""
    return (
        F.when(F.col("from_zero"), "from_zero").when(~F.col("scope_key").eqNullSafe(F.col("scope")), "scope_changed").when(F.col("head_reached_at").isNull(), "no_head")
        .when(F.col("now") - F.col("head_reached_at") > HEAD_AGE_SECONDS, "head_too_old")
    )


def unusable_reason() -> Column:
    """rebuild_reason, then at_head, transient_parks, pending_removals and the clock."""
    return (
        F.when(rebuild_reason().isNotNull(), rebuild_reason()).when(~F.col("at_head"), "not_at_head").when(F.col("transient_parks") > 0, "transient_park").when(F.col("pending_removals") > 0, "pending_removal")
        .when(F.col("head_reached_at") > F.col("now") + CLOCK_SKEW_SECONDS, "clock_skew")
    )


def incomplete() -> Column:
    return F.col("from_zero") | ~F.col("at_head") | (F.col("transient_parks") > 0) | (F.col("pending_removals") > 0)


def graph_rider(asked: Column, served: Column, held: Column) -> Column:
    """Cleared where it was asked for and not served."""
    return F.when(served.isNotNull(), served).when(asked, F.lit(None)).otherwise(held)


def related_rider(served: Column, held: Column) -> Column:
    """Kept where it was not served."""
    return F.coalesce(served, held)


def delta_verdict(epoch: Column, served_epoch: Column, cursor: Column, head: Column, ledger: Column, live: Column) -> Column:
    """none, pending, epoch_mismatch or rebuild_required; the order of the last two tests is this engine's own."""
    return F.when(epoch != served_epoch, "epoch_mismatch").when(head > cursor, "pending").when(ledger != live, "rebuild_required").otherwise("none")
