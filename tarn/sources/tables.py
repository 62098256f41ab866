"""Sources: Parquet tables, and the note-graph relations derived from them (nodes, edges, tags, change log, states)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attachments are pages; their ids stand beyond all note ids.
ATTACHMENT_BASE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table that is small in bytes, and so read by few tasks, dealt to all of them: for work that takes long by row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def link_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes: (id, live, priority)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("live"), F.col("o_orderpriority").alias("priority"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links: (src, kind, dst, att, ref)."""
    flag, part, order = F.col("l_returnflag"), F.col("l_partkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        order.alias("src"), F.when(flag == "N", "wikilink").when(flag == "R", "embed").otherwise("markdown").alias("kind"),
        F.when(flag == "N", F.when(part % 50 == 0, order).otherwise(part)).alias("dst"), F.when(flag == "R", part % 250 + ATTACHMENT_BASE).alias("att"),
        F.when(flag == "A", F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("p"), part.cast("string")))).otherwise("x").alias("ref"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as attachments: (id, path, live)."""
    return table(spark, sf_dir, "pages").select((F.col("page_id") + ATTACHMENT_BASE).alias("id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), (F.col("page_id") % 7 != 0).alias("live"))


def doc_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: (id, path, live, n_chars)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("id"), doc_path().alias("path"), (F.coalesce("toxic", F.lit(0)) != 1).alias("live"), "n_chars")


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change rows: (id, rev, trashed, stamp, kind)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("rev"), (F.col("event_type") == "error").alias("trashed"), F.col("value").alias("stamp"), F.col("event_type").alias("kind"))


def sampled_state(nodes: DataFrame) -> DataFrame:
    """A recorded state: two thirds of the nodes, with older revisions for some: (id, rev)."""
    return nodes.filter(F.col("id") % 3 != 0).select("id", F.when(F.col("id") % 5 == 0, F.col("rev") - 1).otherwise(F.col("rev")).alias("rev"))


#: The same relations as DuckDB views, for the oracle.
SQL = {
    "ln": "SELECT o_orderkey AS id, o_orderstatus <> 'F' AS live, o_orderpriority AS priority FROM orders",
    "e": f"""SELECT l_orderkey AS src, CASE l_returnflag WHEN 'N' THEN 'wikilink' WHEN 'R' THEN 'embed' ELSE 'markdown' END AS kind,
        CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_partkey % 50 = 0 THEN l_orderkey ELSE l_partkey END END AS dst,
        CASE WHEN l_returnflag = 'R' THEN l_partkey % 250 + {ATTACHMENT_BASE} END AS att,
        CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber = 1 THEN '' ELSE 'p' || l_partkey END ELSE 'x' END AS ref FROM lineitem""",
    "a": f"SELECT page_id + {ATTACHMENT_BASE} AS id, 'pages/' || page_id || '.html' AS path, page_id % 7 <> 0 AS live FROM pages",
    "dn": "SELECT d.doc_id AS id, source || '/' || lang || '/' || d.doc_id || '.md' AS path, coalesce(toxic, 0) <> 1 AS live, d.n_chars FROM documents d LEFT JOIN labels USING (doc_id)",
    "cl": "SELECT user_id AS id, event_id AS rev, event_type = 'error' AS trashed, value AS stamp, event_type AS kind FROM events",
    "lt": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev DESC) AS n FROM cl) WHERE n = 1",
    "st": "SELECT id, CASE WHEN id % 5 = 0 THEN rev - 1 ELSE rev END AS rev FROM lt WHERE id % 3 <> 0",
}


def with_sql(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + body
