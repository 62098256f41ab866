"""The read path: mount selection, lookups by id or path in several mounts at once, what a miss means, what qualifies an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import rules

FAILED, NOT_IN_MIRROR = 2, 3
#: Misses that are no answers about the mirror's contents, since it could not be looked at.
NO_ANSWER = ("state_unreadable", "state_lost", "not_this_mirror", "mount_held", "marker_unreadable", "unreadable")


def select_mounts(selectors: DataFrame, mounts: DataFrame) -> DataFrame:
    """(selector, mount, problem) for selectors(selector) over mounts(mount, workspace): a null one selects all mounts, a blank one is
    `usage`; a name goes before a workspace id, and one that several mounts bear is `ambiguous_mount`; else `no_such_mount`."""
    asked = selectors.select("selector").distinct().withColumn("wanted", F.trim("selector"))
    named = mounts.select(F.trim("mount").alias("wanted"), "mount", "workspace")
    every = asked.filter("selector is null").join(F.broadcast(mounts.select("mount"))).select("selector", "mount", F.lit(None).cast("string").alias("problem"))  # mounts are configured by hand
    some = asked.filter("selector is not null")
    by_name = some.join(named, "wanted").groupBy("selector").agg(F.count(F.lit(1)).alias("n"), F.min("mount").alias("by_name"))
    by_id = some.join(mounts.select(F.lower("workspace").alias("workspace"), F.col("mount").alias("by_id")), F.lower("wanted") == F.col("workspace")).select("selector", "by_id")
    found = some.join(by_name, "selector", "left").join(by_id, "selector", "left")
    problem = F.when(F.col("wanted") == "", "usage").when(F.col("n") > 1, "ambiguous_mount").when(F.coalesce("by_name", "by_id").isNull(), "no_such_mount")
    chosen = F.when(problem.isNull(), F.coalesce("by_name", "by_id"))
    return every.unionByName(found.select("selector", chosen.alias("mount"), problem.alias("problem")))


def locate(targets: DataFrame, mounts: DataFrame, nodes: DataFrame, parks: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """(target, mount, id, outcome) of each of targets(target, mount, id, path), which name an id or else a path.

    mounts(mount, identity, state): identity is ours, foreign, held or unreadable, state is present, absent or unreadable;
    nodes(mount, id, path, kind), parks(mount, id, path), ledger(mount, id); files(mount, id, fact) tells of a file that cannot
    be served: gone, escaped or unreadable. The first that holds decides: an identity that cannot be known, the state, another
    mirror, a park (before the node, since a parked node is none), nothing held (in the ledger only, if asked by id), a folder, the file; else `hit`.
    """
    path = rules.normal_server_path(F.col("path"))
    asked = targets.select("target", "mount", F.col("id").alias("wanted"), F.when(F.col("id").isNull(), path).alias("wanted_path"))

    yes, parts = F.lit(True), int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = files.groupBy("mount", "id").agg(F.min("fact").alias("fact"))
    # what is known of an id, and of a path: one row a key, so a target meets one row and is not grouped again
    every = nodes.select("mount", "id", "kind", yes.alias("held")).unionByName(parks.select("mount", "id", yes.alias("parked")), True)
    every = every.unionByName(ledger.select("mount", "id", yes.alias("delivered")), True).unionByName(facts, True)
    of_id = every.groupBy("mount", "id").agg(F.bool_or("held").alias("held"), F.bool_or("parked").alias("parked"), F.bool_or("delivered").alias("delivered"), F.min("kind").alias("kind"), F.min("fact").alias("fact"))
    node = nodes.join(facts, ["mount", "id"], "left").select("mount", "path", F.struct("id", "kind", "fact").alias("node"))
    of_path = node.unionByName(parks.select("mount", "path", yes.alias("parked")), True).groupBy("mount", "path").agg(F.min("node").alias("node"), F.bool_or("parked").alias("parked"))

    def looked_up(rows: DataFrame, name: str, known: DataFrame) -> DataFrame:
        """Targets are dealt to a fixed number of tasks: their keys are alike, so tasks of so many compressed bytes would be large ones."""
        return rows.repartition(parts, "mount", name).join(known, ["mount", name], "left")

    by_id = looked_up(asked.filter("wanted is not null").select("target", "mount", "wanted"), "wanted", of_id.withColumnRenamed("id", "wanted"))
    by_id = by_id.select("target", "mount", F.when(F.col("held"), F.col("wanted")).alias("id"), "kind", "fact", "parked", "delivered")
    by_path = looked_up(asked.filter("wanted is null").select("target", "mount", "wanted_path"), "wanted_path", of_path.withColumnRenamed("path", "wanted_path"))
    by_path = by_path.select("target", "mount", "node.id", "node.kind", "node.fact", "parked", F.lit(False).alias("delivered"))
    rows = by_id.unionByName(by_path).join(F.broadcast(mounts), "mount")  # mounts are configured by hand
    ours = F.col("identity") == "ours"
    outcome = (
        F.when(F.col("identity") == "held", "mount_held").when(F.col("identity") == "unreadable", "marker_unreadable").when(F.col("state") == "unreadable", "state_unreadable")
        .when((F.col("state") == "absent") & ~ours, "never_synced").when(F.col("state") == "absent", "state_lost").when(~ours, "not_this_mirror")
        .when(F.col("parked"), "parked").when(F.col("id").isNull() & F.col("delivered"), "ledger_only").when(F.col("id").isNull(), "not_held")
        .when(F.col("kind") == "folder", "folder").when(F.col("fact").isNotNull(), F.col("fact")).otherwise("hit")
    )
    return rows.select("target", "mount", F.when(outcome == "hit", F.col("id")).alias("id"), outcome.alias("outcome"))


def answered(outcome: Column) -> Column:
    """Whether a mount answered: a hit or a miss that is a fact about its contents."""
    return ~outcome.isin(*NO_ANSWER)


def miss_code(outcome: Column) -> Column:
    return F.when(outcome.isin(*NO_ANSWER), "unavailable").when(outcome == "folder", "usage").otherwise("not_in_mirror")


def miss_exit(outcome: Column) -> Column:
    return F.when(outcome.isin(*NO_ANSWER, "folder"), FAILED).otherwise(NOT_IN_MIRROR)


def across_mounts(located: DataFrame) -> DataFrame:
    """(target, verdict, exit, mounts, unverified) of located(target, mount, id, outcome).

    Several hits are `ambiguous` and name their mounts; one is `found`, and names the mounts that could not be looked at; of misses
    the gravest code counts: unavailable over usage over not_in_mirror. Lists are as long as there are mounts.
    """
    hit = F.col("outcome") == "hit"
    rank = F.when(hit, -1).when(miss_code(F.col("outcome")) == "unavailable", 2).when(miss_code(F.col("outcome")) == "usage", 1).otherwise(0)
    names = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("mount"))))
    rows = located.groupBy("target").agg(F.count_if(hit).alias("hits"), names(hit).alias("mounts"), names(~answered(F.col("outcome"))).alias("silent"), F.max_by("outcome", rank).alias("worst"))
    verdict = F.when(F.col("hits") > 1, "ambiguous").when(F.col("hits") == 1, "found").otherwise(miss_code(F.col("worst")))
    code = F.when(F.col("hits") > 1, FAILED).when(F.col("hits") == 1, 0).otherwise(miss_exit(F.col("worst")))
    return rows.select("target", verdict.alias("verdict"), code.alias("exit"), "mounts", F.when(F.col("hits") == 1, F.col("silent")).otherwise(F.expr("cast(array() as array<string>)")).alias("unverified"))


def read_disclosures(observed: Column, recorded: Column, scoped: Column, graph_held: Column, unusable: Column, utf8: Column) -> Column:
    """Codes that qualify served bytes: a digest that is not recorded is unknown, never right."""
    blank = F.coalesce(recorded, F.lit("")) == ""
    return F.array_compact(
        F.array(
            F.when(blank, "digest_unknown").when(observed != recorded, "digest_mismatch"), F.when(scoped & graph_held, "graph_wider_than_mount"),
            F.when(unusable.isNotNull(), "mirror_not_usable"), F.when(~utf8, "not_utf8"),
        )
    )


def line_span(text: Column, low: Column, high: Column) -> Column:
    """struct(part, from, to, total, error) of lines low to high: `high` is cut to the end, a `low` beyond it is `past_end`; the empty
    text has lines 0-0 of 0."""
    total = rules.line_count(text)
    empty = total == 0
    error = F.when(F.when(empty, low > 1).otherwise(low > total), "past_end")
    good = error.isNull()
    upto = F.least(F.coalesce(high, total), total)
    return F.struct(
        F.when(good, F.when(empty, "").otherwise(rules.slice_lines(text, low, upto))).alias("part"), F.when(good, F.when(empty, 0).otherwise(low)).cast("int").alias("from"),
        F.when(good, F.when(empty, 0).otherwise(upto)).cast("int").alias("to"), total.alias("total"), error.alias("error"),
    )
