"""Pages of a change log applied to a mirror's books, page by page, or pages that do not meet at once.

A page goes through the cascade of dispositions, the fixpoint of collisions with what stands and what is parked, and the rules of
redelivery against the disk; then all of it is committed under one manifest: tracked nodes, ledger, parks, debts (folders that could
not be removed yet), the work to be done on disk, and the position with its riders. A page that comes again finds its manifest and changes
nothing. The order of work on disk is: files and folders written, then files removed, then folders, the deepest first, then what was
in the way of another kind.

Where no disk is looked at, apply_pages() takes many pages a micro-batch and cuts them into runs of pages of which no two meet (see
meetings()); a run is applied at once, to the same books that its pages, one after the other, would leave.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import rules
from tarn.operators import changes
from tarn.sources import pull, scratch

SCHEMAS = {
    "nodes": "id long, path string, place string, fold_key string, kind string, rev long, sha string, stamp string",
    "ledger": "id long",
    "parks": "id long, path string, class string, reason string",
    "debts": "id long, path string, fold_key string",
}
WORK = "step int, op string, id long, path string"
#: Steps of the work on disk.
WRITE, REMOVE_FILE, REMOVE_FOLDER, WRITE_LATE = 1, 2, 3, 4
COLUMNS = ("id", "rev", "kind", "path", "trashed", "sha", "stamp")
#: Pages of a micro-batch of which many may be applied at once.
PAGES = 2048


@dataclass(frozen=True)
class Standing:
    """The position of a mirror's books: key and epoch of the last page, and what goes with the head."""

    rev: int = 0
    id: int = 0
    epoch: int = 0
    at_head: bool = False
    from_zero: bool = False
    head_reached_at: int | None = None
    graph: str | None = None
    related: str | None = None


@dataclass(frozen=True)
class Riders:
    """What the server sends along with the head: its number of live nodes, and stamps of the graph and of the ranking, if served."""

    live_nodes: int | None
    graph_asked: bool = False
    graph: str | None = None
    related: str | None = None


class Books:
    """Tables dealt to parts by id; a commit rewrites the parts that it touches and names, in one manifest, the version of each part of
    each table, so all tables change together or not at all."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _numbers(self) -> list[int]:
        return sorted(int(n[2:]) for n in scratch.names_in(self.spark, f"{self.path}/manifest") if n.startswith("v=") and n[2:].isdigit())

    def manifest(self, number: int | None = None) -> dict:
        number = max(self._numbers(), default=None) if number is None else number
        raw = None if number is None else scratch.read_text(self.spark, f"{self.path}/manifest/v={number}")
        return json.loads(raw) if raw else {"number": -1, "batch": -1, "parts": {}, "standing": asdict(Standing())}

    def standing(self) -> Standing:
        return Standing(**self.manifest()["standing"])

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        parts = self.manifest()["parts"].get(name, {})
        paths = [f"{self.path}/{name}/v={v}/part={p}" for p, v in sorted(parts.items()) if only is None or int(p) in only]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def work(self, number: int) -> DataFrame:
        """What a version has to do on disk: (step, op, id, path)."""
        return self.spark.read.schema(WORK).parquet(f"{self.path}/work/v={number}").orderBy("step", F.desc(rules.depth_of(F.col("path"))), "path")

    def commit(self, batch: int | None, gone: dict[str, DataFrame], added: dict[str, DataFrame], work: DataFrame, standing: Standing) -> None:
        """The next version: each table without the ids of `gone` and `added`, and with the rows of `added`. batch: the micro-batch that it
        comes from, if any."""
        part = F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")
        before = self.manifest()
        number, parts = before["number"] + 1, {name: dict(held) for name, held in before["parts"].items()}
        for name, rows in added.items():
            out = gone[name].select("id").union(rows.select("id")).distinct()
            touched = sorted(r[0] for r in out.select(part.alias("p")).distinct().collect())  # at most `parts` numbers
            if touched:
                columns = self.spark.createDataFrame([], SCHEMAS[name]).columns
                stay = self.read(name, touched).join(out, "id", "left_anti").select(*columns)
                made = stay.unionByName(rows.select(*columns)).withColumn("part", part)
                made.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/v={number}")
                there = {int(n[5:]) for n in scratch.names_in(self.spark, f"{self.path}/{name}/v={number}") if n.startswith("part=")}
                held = parts.setdefault(name, {})
                for p in touched:
                    held.pop(str(p), None)
                held.update({str(p): number for p in there})
        work.write.mode("overwrite").parquet(f"{self.path}/work/v={number}")
        scratch.write_new(self.spark, f"{self.path}/manifest/v={number}", json.dumps({"number": number, "batch": before["batch"] if batch is None else batch, "parts": parts, "standing": asdict(standing)}))

    def vacuum(self, keep: int = 2) -> None:
        """Drop manifests and their work but the last `keep`, and data that none of those names."""
        numbers = self._numbers()
        needed = {(name, v) for n in numbers[-keep:] for name, held in self.manifest(n)["parts"].items() for v in held.values()}
        for n in numbers[:-keep]:
            scratch.delete(self.spark, f"{self.path}/manifest/v={n}")
            scratch.delete(self.spark, f"{self.path}/work/v={n}")
        for name in SCHEMAS:
            for folder in scratch.names_in(self.spark, f"{self.path}/{name}"):
                if folder.startswith("v=") and (name, int(folder[2:])) not in needed and int(folder[2:]) <= numbers[-1]:
                    scratch.delete(self.spark, f"{self.path}/{name}/{folder}")


def _above(path: Column) -> Column:
    """All proper ancestors of a path."""
    parts = F.split(path, "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, made).otherwise(F.expr("cast(array() as array<string>)"))


def _occupied(folders: DataFrame, paths: DataFrame) -> DataFrame:
    """Of folders(path), those below which a path of paths(path) lies."""
    return paths.select(F.explode(_above(F.col("path"))).alias("path")).join(folders.select("path").distinct(), "path", "left_semi").distinct()


def apply_page(books: Books, rows: DataFrame, batch: int | None, limit: int, riders: Riders, now: int, epoch: int, disk: DataFrame | None = None, scope: str | None = None) -> Standing:
    """Apply a page of at most `limit` rows(id, rev, kind, path, trashed, sha, stamp), micro-batch number `batch`; a page that is not full
    is the head.

    disk: (path, is_folder, sha) of what stands in the mirror; nothing, if it is not given. At the head the number of live nodes must be
    known (else nothing is committed, and it is an error) and must be the ledger's, or a rebuild is due.
    """
    spark, old = books.spark, books.standing()
    if batch is not None and batch <= books.manifest()["batch"]:
        return old  # this page was committed
    rows = _kept(spark, rows.select(*COLUMNS))
    return _apply(books, rows, batch, rows.count() < limit, riders, now, epoch, disk, scope)


def _kept(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows written and read by the books' session: a stream's own does not plan anew at run time."""
    path = scratch.new_path(spark, "page")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _apply(books: Books, rows: DataFrame, batch: int | None, at_head: bool, riders: Riders, now: int, epoch: int, disk: DataFrame | None, scope: str | None, several: bool = False) -> Standing | None:
    """apply_page() for kept rows: those of one page, or with their `page` of several that do not meet; None, and nothing is done, where the
    collisions of several pages take more rounds than one of them has, or go in a cycle."""
    spark, old = books.spark, books.standing()
    if at_head and riders.live_nodes is None:
        raise ValueError("the log ends without a number of live nodes")
    page = scratch.store(changes.latest(rows))
    end = rows.agg(F.max(F.struct("rev", "id"))).first()[0]
    disk = disk if disk is not None else spark.createDataFrame([], "path string, is_folder boolean, sha string")
    nodes, ledger, parks, debts = (books.read(n) for n in ("nodes", "ledger", "parks", "debts"))

    # dispositions, then collisions: delivered ids hold nothing of what they held
    local = rules.scope_relative(F.col("path"), scope) if scope else F.col("path")
    told = changes.classify(page, nodes.select("id"), scope)
    facts = page.select("id", "rev", "kind", "sha", "stamp", F.struct("rev", "id").alias("seq"))
    told = scratch.store(told.join(facts, "id").withColumn("path", F.coalesce(local, F.col("path"))))
    delivered = page.select("id")
    held = nodes.join(delivered, "id", "left_anti").join(ledger, "id", "left_semi").select("id", "path")
    puts = told.filter("disposition in ('put', 'park')")
    fewest = puts.join(page.select("id", "page"), "id").groupBy("page").count().agg(F.min("count")).first()[0] if several else None
    puts = puts.select("id", "path", "seq", (F.col("disposition") == "park").alias("parked"))
    clashes = changes.collision_fixpoint(puts, held, parks.join(delivered, "id", "left_anti").select("id", "path"), fewest)
    if clashes is None:
        return None
    told = told.join(clashes.select("id", "park"), "id", "left")

    # what a put meets on disk: owned are the places that were tracked before this page
    place = F.when(F.col("kind") == "attachment", F.concat("path", F.lit(rules.CONTROL_SUFFIX))).otherwise(F.col("path"))
    free = rules.with_fold_key(told.filter("disposition = 'put' and park is null").select("id", place.alias("place"), "kind", "sha"), "place")
    owned = nodes.select("fold_key", F.lit(True).alias("owned")).distinct()
    own = nodes.select("id", F.col("fold_key").alias("was_key"), F.nullif("sha", F.lit("")).alias("last_sha"))
    there = disk.select(F.col("path").alias("place"), "is_folder", F.col("sha").alias("disk_sha"))
    met = free.join(there, "place", "left").join(owned, "fold_key", "left").join(own, "id", "left")
    folder, same = F.col("kind") == "folder", F.col("disk_sha") == F.col("sha")
    edited = (F.col("was_key") == F.col("fold_key")) & (F.col("disk_sha") != F.col("last_sha")) & ~same
    outcome = (
        F.when(F.col("is_folder").isNull(), "write").when(folder & F.col("is_folder"), "write")
        .when(folder != F.col("is_folder"), F.when(F.col("owned"), "late").otherwise("park_transient"))
        .when(F.col("owned"), F.when(edited, "overwrite_edit").otherwise("overwrite")).when(same, "adopt").otherwise("park_transient")
    )
    met = scratch.store(met.withColumn("outcome", outcome))

    placed = told.join(met.select("id", "place", "fold_key", "outcome"), "id", "left")
    stays = F.col("outcome").isNotNull() & (F.col("outcome") != "park_transient")
    tracked = scratch.store(placed.filter(stays).select("id", "path", "place", "fold_key", changes.known_kind(F.col("kind")).alias("kind"), "rev", F.when(folder, "").otherwise(F.col("sha")).alias("sha"), "stamp"))
    reason = F.coalesce(F.when(F.col("outcome") == "park_transient", "occupied"), F.when(F.col("park") != "classified", F.col("park")), F.col("reason"))
    kind_of_park = F.when(F.col("outcome") == "park_transient", "transient").otherwise("structural")
    parked = placed.filter(~F.coalesce(stays, F.lit(False)) & F.col("disposition").isin("put", "park"))
    parked = parked.select("id", "path", kind_of_park.alias("class"), reason.alias("reason"))

    # what goes: places of nodes that are tracked no more, or elsewhere, unless somebody stands there now
    after = scratch.store(nodes.join(page.select("id"), "id", "left_anti").unionByName(tracked.select(*nodes.columns)))
    left = nodes.join(page.select("id"), "id", "left_semi").join(tracked.select("id", F.col("fold_key").alias("now_key")), "id", "left")
    left = left.filter(~F.col("fold_key").eqNullSafe(F.col("now_key"))).join(after.select("fold_key"), "fold_key", "left_anti").filter("place <> ''")
    left = scratch.store(left.select("id", F.col("place").alias("path"), "fold_key", "kind"))
    files, folders = left.filter("kind <> 'folder'").select("id", "path"), left.filter("kind = 'folder'").select("path", "fold_key")
    due = (folders.unionByName(debts.select("path", "fold_key")) if at_head else folders).distinct()
    due = scratch.store(due.join(after.select("fold_key"), "fold_key", "left_anti").filter("path <> ''"))
    remains = after.select(F.col("place").alias("path")).union(disk.join(files, "path", "left_anti").join(due, "path", "left_anti").select("path"))
    blocked = scratch.store(_occupied(due, remains))
    removed, owed = due.join(blocked, "path", "left_anti"), due.join(blocked, "path", "left_semi")

    op = lambda rows, step, name: rows.select(F.lit(step).alias("step"), name.alias("op"), F.col("id").cast("long").alias("id"), "path")
    met = met.withColumnRenamed("place", "path")
    early = met.filter("outcome not in ('late', 'park_transient')")
    work = op(early, WRITE, F.col("outcome")).unionByName(op(files, REMOVE_FILE, F.lit("remove")))
    work = work.unionByName(op(removed.withColumn("id", F.lit(None)), REMOVE_FOLDER, F.lit("remove_folder"))).unionByName(op(met.filter("outcome = 'late'"), WRITE_LATE, F.lit("write")))

    number_of = lambda rows: rows.withColumn("id", F.xxhash64("path"))
    settled = debts if at_head else debts.limit(0)
    new = Standing(*(end or (old.rev, old.id)), epoch, at_head=False, head_reached_at=old.head_reached_at, graph=old.graph, related=old.related, from_zero=old.from_zero)
    if at_head:
        count = ledger.join(page.select("id"), "id", "left_anti").count() + page.filter("not trashed").count()
        if count != riders.live_nodes:
            new = replace(new, from_zero=True)
        else:
            graph = riders.graph if riders.graph is not None or riders.graph_asked else old.graph
            new = replace(new, at_head=True, head_reached_at=now, graph=graph, related=riders.related or old.related)
    gone = {"nodes": delivered, "ledger": page.filter("trashed").select("id"), "parks": delivered, "debts": settled.select("id")}
    added = {"nodes": tracked, "ledger": page.filter("not trashed").select("id"), "parks": parked, "debts": number_of(owed)}
    books.commit(batch, gone, added, work, new)
    books.vacuum()
    return new


def meetings(rows: DataFrame, nodes: DataFrame, parks: DataFrame, scope: str | None = None) -> DataFrame:
    """(page, before) of rows(page, id, rev, kind, path, trashed): the last earlier page that a page meets, if any. Pages meet, whatever comes of it,
    where they deliver one id; where a folded path or place that one of them gives or takes away is given or taken away by the other; and where
    something that one of them gives or takes away lies below a path of the other that bars or holds it: what is parked or was, a delivery whose
    folded path another node has too, or a folder that was tracked. Pages of which no two meet read nothing that another of them changes.

    nodes and parks are those before the first page; what a page's ids held before it comes from them, or from the page that delivered them last.
    """
    told = rows.groupBy("page", "id").agg(F.max_by(F.struct("kind", "path", "trashed"), "rev").alias("r")).select(F.struct("page", "id").alias("id"), "r.*")
    told = told.join(changes.classify(told, told.select("id").limit(0), scope).select("id", "disposition"), "id").select("id.*", "kind", "path", "disposition")
    local = F.coalesce(rules.scope_relative(F.col("path"), scope), F.col("path")) if scope else F.col("path")
    told = told.withColumn("path", local).withColumn("place", F.when(F.col("kind") == "attachment", F.concat("path", F.lit(rules.CONTROL_SUFFIX))).otherwise(F.col("path")))
    here, put = Window.partitionBy("id").orderBy("page"), F.col("disposition") == "put"
    before = F.lag(F.struct("page", F.when(F.col("disposition").isin("put", "park"), F.struct("path", "place", "kind")).alias("had"))).over(here)
    node = nodes.select("id", F.struct("path", "place", "kind").alias("node"))
    rows = told.withColumn("before", before).join(node, "id", "left").join(parks.select("id", F.col("path").alias("lifted")), "id", "left")
    first = F.col("before").isNull()
    had = F.when(first, F.col("node")).otherwise(F.col("before.had"))
    lifted = F.when(first, F.col("lifted")).otherwise(F.col("before.had.path"))
    none = F.expr("cast(array() as array<string>)")
    touched = F.array_union(F.when(put, F.array("path", "place")).otherwise(none), F.when(had.isNotNull(), F.array(had["path"], had["place"])).otherwise(none))
    was_folder = F.when(had["kind"] == "folder", had["place"])
    rows = scratch.store(rows.select("page", "id", "path", put.alias("put"), F.col("before.page").alias("before"), touched.alias("touched"), F.array_compact(F.array(F.when(F.col("disposition") == "park", F.col("path")), lifted, was_folder)).alias("bars")))

    keys = scratch.store(rules.with_fold_key(rows.select("page", "id", F.explode("touched").alias("path"))).select("page", "id", "fold_key").distinct())
    shared = keys.select("fold_key", "page").distinct().withColumn("before", F.lag("page").over(Window.partitionBy("fold_key").orderBy("page")))
    given = rules.with_fold_key(rows.filter("put").select("page", "id", "path"))
    holders = rules.with_fold_key(nodes.select("id", "path")).select("fold_key", "id").union(keys.select("fold_key", "id")).join(given.select("fold_key"), "fold_key", "left_semi")
    several = holders.groupBy("fold_key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    bars = rows.select("page", F.explode("bars").alias("path")).union(given.join(several, "fold_key", "left_semi").select("page", "path"))
    bars = bars.groupBy("path").agg(F.collect_set("page").alias("pages"))  # of a path as many as a micro-batch has pages
    below = rows.select("page", F.explode("touched").alias("path")).select("page", F.explode(_above(F.col("path"))).alias("path"))
    below = below.join(bars, "path").select("page", "path", "pages").distinct()
    earlier, later = (F.filter("pages", lambda x: x < F.col("page")), F.filter("pages", lambda x: x > F.col("page")))
    pairs = below.select("page", F.array_max(earlier).alias("before")).union(below.select(F.array_min(later), "page"))
    pairs = pairs.union(shared.select("page", "before")).union(rows.select("page", "before"))
    return pairs.dropna().groupBy("page").agg(F.max("before").alias("before"))


def runs(numbers: list[int], before: dict[int, int]) -> list[list[int]]:
    """Pages cut into runs: one that meets a page of the run so far begins the next."""
    out: list[list[int]] = []
    for n in numbers:
        if out and before.get(n, -1) < out[-1][0]:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def apply_pages(books: Books, rows: DataFrame, batch: int, limit: int, riders: Riders, now: int, epoch: int, scope: str | None = None) -> Standing:
    """apply_page() for the pages of a micro-batch, rows(page, id, ...), in as few runs as they meet in. The last run is committed with the
    batch's number; a batch that comes again goes on after the books' position."""
    old = books.standing()
    if batch <= books.manifest()["batch"]:
        return old
    rows = _kept(books.spark, changes.after(rows.select("page", *COLUMNS), old.rev, old.id))
    sizes = dict(sorted((r["page"], r["count"]) for r in rows.groupBy("page").count().collect()))  # a number a page
    if not sizes:
        return old
    last = max(sizes)
    at_head = sizes[last] < limit
    met = {r["page"]: r["before"] for r in meetings(rows, books.read("nodes"), books.read("parks"), scope).collect()} if len(sizes) > 1 else {}
    todo = runs(list(sizes), met)
    if at_head and riders.live_nodes is None and len(todo[-1]) > 1:
        todo[-1:] = [todo[-1][:-1], todo[-1][-1:]]  # what comes before the head is committed
    while todo:
        run = todo.pop(0)
        some, end = rows.filter(F.col("page").between(run[0], run[-1])), run[-1] == last
        done = _apply(books, some, batch if end else None, at_head and end, riders, now, epoch, None, scope, len(run) > 1)
        if done is None:
            todo[:0] = [run[: len(run) // 2], run[len(run) // 2 :]]
    return books.standing()


def follow(books: Books, log: str, checkpoint: str, riders: Riders, now: int, disk: Callable[[], DataFrame] | None = None, page: int = changes.PAGE_ROWS, scope: str | None = None) -> Standing:
    """Read a published log from the books' position and apply it until its head; also one that ends with a full page. With a disk, which may change
    from page to page, every page is a micro-batch."""
    old, found = books.standing(), pull.head(books.spark, log)
    stream = pull.pull(books.spark, log, (old.rev, old.id), old.epoch or None, page, 1 if disk else PAGES)

    def step(rows: DataFrame, number: int) -> None:
        if disk:
            apply_page(books, rows, number, page, riders, now, found["epoch"], disk(), scope)
        else:
            apply_pages(books, rows.withColumn("page", F.spark_partition_id()), number, page, riders, now, found["epoch"], scope)

    pull.collected_pages(stream, checkpoint, step)
    last = books.standing()
    if not last.at_head and not last.from_zero:  # the last page was full, so an empty one is the head
        nothing = books.spark.createDataFrame([], "id long, rev long, kind string, path string, trashed boolean, sha string, stamp string")
        last = apply_page(books, nothing, None, page, riders, now, found["epoch"], disk() if disk else None, scope)
    return last
