"""Graph reads over nodes(id, live, ...), edges(src, kind, dst, att, ref) and tags; every read is for all subjects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.sources.scratch import store

#: Rows, about, that one task holds at once where a whole relation is joined or made distinct.
ROWS_A_TASK = 250_000


def _live(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter("live").select(F.col("id").alias(name))


def tag_counts(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """tags(node, tag): live nodes per tag."""
    return tags.join(_live(nodes, "node"), "node", "left_semi").groupBy("tag").agg(F.countDistinct("node").alias("n"))


def tag_list(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """tag_counts() with the place of each tag: the most frequent first, then by name."""
    return global_rank(tag_counts(tags, nodes), [-F.col("n"), F.col("tag")], "place")


def tagged(tags: DataFrame, nodes: DataFrame, tag: str) -> DataFrame:
    """Live nodes that carry exactly the tag, with all their tags."""
    every = tags.join(_live(nodes, "node"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return every.filter(F.array_contains("tags", tag))


def node_tags(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    return tags.join(_live(nodes, "node"), "node", "left_semi").select("node", "tag").distinct()


def backlinks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject, other): distinct live sources; a self edge counts, the subject's own liveness doesn't."""
    return edges.filter("dst is not null").select("src", "dst").distinct().join(_live(nodes, "src"), "src", "left_semi").select(F.col("dst").alias("subject"), F.col("src").alias("other"))


def forward_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject, other): distinct live targets other than the subject."""
    return edges.filter("dst is not null and dst <> src").select("src", "dst").distinct().join(_live(nodes, "dst"), "dst", "left_semi").select(F.col("src").alias("subject"), F.col("dst").alias("other"))


def attachment_embeds(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(subject, other): distinct live attachments of live notes."""
    pairs = edges.filter("att is not null").select("src", "att").distinct()
    return pairs.join(_live(nodes, "src"), "src", "left_semi").join(_live(files, "att"), "att", "left_semi").select(F.col("src").alias("subject"), F.col("att").alias("other"))


def attachment_embedders(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject, other): distinct live notes that embed the attachment, live or not."""
    return edges.filter("att is not null").select("src", "att").distinct().join(_live(nodes, "src"), "src", "left_semi").select(F.col("att").alias("subject"), F.col("src").alias("other"))


def unresolved_refs(edges: DataFrame) -> DataFrame:
    """(subject, ref): distinct dangling references of links that are no embeds."""
    return edges.filter("dst is null and ref <> '' and kind in ('wikilink', 'markdown')").select(F.col("src").alias("subject"), "ref").distinct()


def tasks_for(rows: DataFrame, share: int | None = None) -> int:
    """Tasks that a relation is dealt to, by its number of rows: what one of them holds does not grow with the relation."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (share or ROWS_A_TASK)))


def _ends(edges: DataFrame) -> DataFrame:
    """(subject, what, other) of every edge with a target or an attachment: links, backlinks, and files seen from the file."""
    row = lambda where, subject, what, other: edges.filter(where).select(F.col(subject).alias("subject"), F.lit(what).alias("what"), F.col(other).alias("other"))
    return row("src <> dst", "src", "links", "dst").union(row("dst is not null", "dst", "backlinks", "src")).union(row("att is not null", "att", "files", "src"))


def _held(pairs: DataFrame, held: DataFrame, key: str, tasks: int) -> DataFrame:
    """The pairs whose key is an id of held(id, live) that lives; both are dealt by the key. Ids are made distinct, so no pair comes twice."""
    alive = _live(held, key).repartition(tasks, key).distinct()
    return pairs.repartition(tasks, key).join(alive.hint("merge"), key)


def exclusion_set(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(subject, other): a note's self, links in both directions and embeds; an attachment's self and the notes that embed it.

    A pair needs the other end to live, an embed both ends.
    """
    tasks = tasks_for(edges)
    pairs = _held(_ends(edges), nodes, "other", tasks)
    embeds = pairs.filter("what = 'files'").join(_live(files, "subject"), "subject", "left_semi").select(F.col("other").alias("subject"), F.col("subject").alias("other"))
    self_pairs = nodes.select("id").union(files.select("id")).select(F.col("id").alias("subject"), F.col("id").alias("other"))
    return self_pairs.union(pairs.select("subject", "other")).union(embeds).repartition(tasks, "subject", "other").distinct()


def graph_summary(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Counts per live note: links, backlinks, files and unresolved references; pairs of all kinds are made distinct together, then counted."""
    tasks = tasks_for(edges)
    pairs = _held(_ends(edges), nodes, "other", tasks)
    embeds = pairs.filter("what = 'files'").join(_live(files, "subject"), "subject", "left_semi").select(F.col("other").alias("subject"), "what", F.col("subject").alias("other"))
    linked = pairs.filter("what <> 'files'").select("subject", "what", "other").union(embeds)
    unresolved = edges.filter("dst is null and ref <> '' and kind in ('wikilink', 'markdown')").select(F.col("src").alias("subject"), F.lit("unresolved").alias("what"), "ref")
    what = ("links", "backlinks", "files", "unresolved")
    counted = [df.repartition(tasks, *df.columns).distinct().groupBy("subject").agg(*(F.count_if(F.col("what") == w).alias(w) for w in what)) for df in (linked, unresolved)]
    counts = counted[0].union(counted[1]).repartition(tasks, "subject").groupBy("subject").agg(*(F.sum(w).alias(w) for w in what))
    alive = _live(nodes, "subject").repartition(tasks, "subject")
    return alive.join(counts.hint("merge"), "subject", "left").select("subject", *(F.coalesce(w, F.lit(0)).alias(w) for w in what))


def ls_folder(nodes: DataFrame, folder: str) -> DataFrame:
    """Live nodes right in a folder; a folder that has none and is none (see folder_exists) is absent, not empty."""
    return nodes.filter("live").filter(rules.parent_of(F.col("path")) == folder.strip("/")).select("id", "path", rules.leaf_of(F.col("path")).alias("name"))


def folder_exists(nodes: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, present) of folders(folder): whether a live node lies below it or is it; the root is always there."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    known = nodes.filter("live").select(F.explode(above).alias("key")).distinct().withColumn("known", F.lit(True))
    asked = folders.withColumn("key", F.regexp_replace("folder", r"^/+|/+\z", ""))
    return asked.join(known, "key", "left").select("folder", (F.col("known").isNotNull() | (F.col("key") == "")).alias("present"))


def node_refs(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, name, path, place) of the live nodes among ids(id), by path, then id."""
    rows = nodes.filter("live").join(ids.select("id").distinct(), "id", "left_semi")
    return global_rank(rows.select("id", rules.leaf_of(F.col("path")).alias("name"), "path"), [F.col("path"), F.col("id")], "place")


def global_rank(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds a 1-based rank in a total order without a single sorting task: range partitions are ranked apart, and each gets
    the count of those before it (one row a partition)."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = store(keyed.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))  # ranges are sampled: once
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before", *keys)


def tree_order(nodes: DataFrame) -> DataFrame:
    """Live nodes in order of path components, with their depth."""
    rows = nodes.filter("live").select("id", "path", rules.depth_of(F.col("path")).alias("depth"))
    return global_rank(rows, [F.split("path", "/"), F.col("id")], "place")


def graph_slot() -> Column:
    """Whether a graph can be served, for columns rebuilding, stamped, matches, file_exists, asked; tested in this order."""
    return F.when(F.col("rebuilding"), "rebuilding").when(F.col("matches"), "held").when(F.col("file_exists"), "stale").when(F.col("asked"), "not_served").otherwise("not_synced")
