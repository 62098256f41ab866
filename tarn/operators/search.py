"""Search: predicates, filter-only listings, BM25 ranking (this engine's own), coverage."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import words
from tarn.operators.graph import global_rank
from tarn.sources import scratch

K1, B = 1.2, 0.75
MISFIT = "!misfit"
#: Verdicts on a mirror's delta that this engine knows.
KNOWN_DELTA = ("none", "pending", "epoch_mismatch", "rebuild_required")
#: Documents of a segment: their words are kept too, for merges.
DOCUMENTS = "id long, gone boolean, len int, words string"


@dataclass
class Filter:
    """Conditions are joined by AND, the values of one condition by OR. The value "" asks for rows where the field is not set, MISFIT
    for those whose value does not fit the field's declared kind (`kinds`: number or date; this engine's own test, a cast)."""

    under: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    fields: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, under: list[str], tags: list[str], specs: list[str]) -> Filter:
        """KEY=VALUE, KEY= (not set) or KEY=a..b; white space around keys, values and ends is ignored; one key merges its values and has one
        range at most, with an end at least."""
        out = cls(under=list(under), tags=[t.lstrip("#") for t in tags])
        for spec in specs:
            key, found, value = spec.partition("=")
            key = key.strip()
            if not found or not key:
                raise ValueError(f"not KEY=VALUE: {spec!r}")
            if ".." in value:
                low, high = (x.strip() or None for x in value.split("..", 1))
                if key in out.ranges:
                    raise ValueError(f"a second range of {key!r}: {spec!r}")
                if low is None and high is None:
                    raise ValueError(f"a range without ends: {spec!r}")
                out.ranges[key] = (low, high)
            else:
                out.fields.setdefault(key, []).append(value.strip())
        return out

    def predicate(self, path: str = "path", tags: str = "tags") -> Column:
        """Every condition holds; the values and the range of one key are alternatives of one condition."""
        every = F.lit(True)
        if self.under:
            one = [(F.col(path) == u) | F.startswith(F.col(path), F.lit(u + "/")) for u in self.under]
            every = every & _any(one)
        if self.tags:
            every = every & F.exists(F.col(tags), lambda x: _any([(x == t) | F.startswith(x, F.lit(t + "/")) for t in self.tags]))
        for key in dict.fromkeys([*self.fields, *self.ranges]):
            ways = [self._matches(key, v) for v in self.fields.get(key, [])]
            every = every & _any([*ways, self._within(key, *self.ranges[key])] if key in self.ranges else ways)
        return every

    def _within(self, key: str, low: str | None, high: str | None) -> Column:
        """Whether the value lies between the ends, which count; an end that does not fit the field's kind lets nothing in."""
        value, inside = self._typed(key), F.lit(True)
        for end, holds in ((low, lambda x: value >= x), (high, lambda x: value <= x)):
            if end is not None:
                inside = inside & F.coalesce(holds(self._as_kind(key, F.lit(end))), F.lit(False))
        return inside

    def _typed(self, key: str) -> Column:
        """The field's value as its declared kind; null where it does not fit."""
        return self._as_kind(key, F.col(key).cast("string"))

    def _as_kind(self, key: str, value: Column) -> Column:
        """A text as the field's kind, a number unless it is declared as a date; a number may have a decimal comma."""
        text = F.trim(value)
        if self.kinds.get(key) == "date":
            return F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}\z")), text.try_cast("date"))
        return F.when(F.rlike(text, F.lit(r"^-?[0-9]+([.,][0-9]+)?\z")), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))

    def _matches(self, key: str, value: str) -> Column:
        if value == "":
            return F.col(key).isNull()
        if value == MISFIT:
            return F.col(key).isNotNull() & self._typed(key).isNull() if key in self.kinds else F.lit(False)
        return F.coalesce(F.col(key).cast("string") == value, F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _is(value: str):
    return lambda x: x == value


def listing(rows: DataFrame, where: Filter, changed: str, limit: int) -> DataFrame:
    """Most recently changed first, with the full count: filters come before the cut; a filtered count is one row."""
    kept = rows.filter(where.predicate())
    top = kept.orderBy(F.desc(changed), "id").limit(limit)
    return top.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("total"))))


def bm25(docs: DataFrame, query: list[str], limit: int = 20) -> DataFrame:
    """(id, score) of docs(id, text) for query words: standard BM25, k1 1.2 and b 0.75, words split at non-letters."""
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    counted = docs.select("id", F.filter(words, lambda w: w != "").alias("w"))
    terms = sorted(set(query))
    tf = [F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = counted.select("id", F.size("w").alias("len"), *tf)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    scored = rows.filter(_any([F.col(f"tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return scored.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _words() -> Column:
    return F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def posting_rows(docs: DataFrame) -> DataFrame:
    """(id, len, term, tf) of docs(id, text): a text's words move once, as a whole, to the task of its id, and are counted there; the counts
    do not move."""
    words = docs.select("id", _words().alias("w")).repartition("id")
    return words.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def postings(docs: DataFrame, path: str, parts: int = 64) -> None:
    """Write docs(id, text) as an index for bm25_indexed(): postings(term, id, tf, len) in folders of term hashes, sorted by term, and
    one row of totals. It is written once and read by scans that are pruned to the asked terms."""
    dealt = posting_rows(docs).withColumn("part", _part(F.col("term"), parts)).repartition("part", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("part", "term")
    dealt.write.partitionBy("part").parquet(f"{path}/postings")
    size = F.size(_words())
    docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg"), F.lit(parts).alias("parts")).write.parquet(f"{path}/totals")


class SegmentedIndex:
    """A text index that follows a change log: every batch of documents is a segment of postings, and a document is held by the last segment that
    has it. Removals and replaced documents are tombstones in the small table of what each segment holds; merge() writes one segment
    of what is left. The list of segments is a numbered pointer, so readers see a batch whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 16):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def segments(self) -> list[int]:
        raw = scratch.get_pointer(self.spark, f"{self.path}/SEGMENTS")
        return json.loads(raw) if raw else []

    def apply(self, changed: DataFrame) -> None:
        """Take in changed(id, text, gone), one row an id: what is gone leaves the index, all else replaces what is held of it."""
        held = self.segments()
        number = max((*held, *self._written()), default=0) + 1
        gone = F.coalesce("gone", F.lit(False))
        rows = changed.select("id", gone.alias("gone"), words.spaced(F.when(~gone, F.col("text"))).alias("words"))
        rows.select("id", "gone", words.n_words(F.col("words")).alias("len"), "words").write.parquet(f"{self.path}/segment-{number}/documents")
        self._write(number)
        self._point([*held, number])

    def _written(self) -> list[int]:
        return [int(n[8:]) for n in scratch.names_in(self.spark, self.path) if n.startswith("segment-") and n[8:].isdigit()]

    def _write(self, number: int) -> None:
        """The postings of a segment from its documents: every task inverts its own, and sorts its lists by term."""
        held = self.spark.read.schema(DOCUMENTS).parquet(f"{self.path}/segment-{number}/documents").filter("not gone")
        lists = words.posting_lists(held).withColumn("part", _part(F.col("term"), self.parts))
        lists.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{self.path}/segment-{number}/postings")

    def _point(self, numbers: list[int]) -> None:
        scratch.put_pointer(self.spark, f"{self.path}/SEGMENTS", json.dumps(numbers))

    def documents(self) -> DataFrame:
        """(id, len, segment) of the documents that the index holds."""
        numbers = self.segments()
        if not numbers:
            return self.spark.createDataFrame([], "id long, len int, segment int")
        every = None
        for n in numbers:
            one = self.spark.read.schema("id long, gone boolean, len int").parquet(f"{self.path}/segment-{n}/documents").withColumn("segment", F.lit(n))
            every = one if every is None else every.unionByName(one)
        last = every.groupBy("id").agg(F.max_by(F.struct("gone", "len", "segment"), "segment").alias("x")).select("id", "x.*")
        return last.filter("not gone").select("id", "len", "segment")

    def _postings(self, terms: list[str]) -> DataFrame:
        """(term, id, tf, segment) of asked terms in the segments; rows of replaced documents too."""
        schema = "term string, ids array<long>, tfs array<int>, part int"
        numbers = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_part(F.col("term"), self.parts)).distinct().collect()]
        out = self.spark.createDataFrame([], "term string, id long, tf int, segment int")
        for n in self.segments():
            place = f"{self.path}/segment-{n}/postings"
            if not any(x.startswith("part=") for x in scratch.names_in(self.spark, place)):
                continue  # nothing but removals
            one = self.spark.read.schema(schema).parquet(place).filter(F.col("part").isin(numbers) & F.col("term").isin(terms))
            out = out.unionByName(one.select("term", F.inline(F.arrays_zip("ids", "tfs")).alias("id", "tf"), F.lit(n).alias("segment")))
        return out

    def ranked(self, query: list[str], limit: int = 20) -> DataFrame:
        """(id, score): bm25() of the documents that the index holds."""
        terms = sorted(set(query))
        live = self.documents()
        totals = live.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg"))
        rows = scratch.store(self._postings(terms).join(live, ["id", "segment"]))
        frequency = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        scored = rows.join(F.broadcast(frequency), "term").join(F.broadcast(totals))  # one row a term of the query, and one row
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        return scored.withColumn("s", part).groupBy("id").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    def merge(self) -> None:
        """One segment of all that is held; those before it are dropped when the pointer has moved on twice."""
        old = self.segments()
        number = max((*old, *self._written()), default=0) + 1
        if old:
            every = [self.spark.read.schema(DOCUMENTS).parquet(f"{self.path}/segment-{n}/documents").filter("not gone").withColumn("segment", F.lit(n)) for n in old]
            live = scratch.store(self.documents().select("id", "segment"))
            reduce(DataFrame.unionByName, every).join(live, ["id", "segment"], "left_semi").drop("segment").write.parquet(f"{self.path}/segment-{number}/documents")
        else:
            self.spark.createDataFrame([], DOCUMENTS).write.parquet(f"{self.path}/segment-{number}/documents")
        self._write(number)
        self._point([number])
        kept = {n for raw in scratch.pointers(self.spark, f"{self.path}/SEGMENTS") for n in json.loads(raw)}
        for n in self._written():
            if n not in kept and n < number:
                scratch.delete(self.spark, f"{self.path}/segment-{n}")


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def bm25_indexed(spark: SparkSession, path: str, query: list[str], limit: int = 20) -> DataFrame:
    """(id, score): bm25() from an index of postings(); only the folders and row groups of the asked terms are read."""
    totals = spark.read.parquet(f"{path}/totals").first()  # one row
    if totals is None:
        raise ValueError(f"no index at {path}")
    terms = sorted(set(query))
    numbers = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_part(F.col("term"), totals["parts"])).distinct().collect()]
    rows = spark.read.schema("term string, id long, tf int, len int, part int").parquet(f"{path}/postings").filter(F.col("part").isin(numbers) & F.col("term").isin(terms))
    frequency = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (totals["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(totals["avg"])))
    scored = rows.join(F.broadcast(frequency), "term").withColumn("s", part)  # one row a term of the query
    return scored.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def ranked_hits(scores: DataFrame, nodes: DataFrame, texts: DataFrame, terms: list[str], width: int = 160) -> DataFrame:
    """(id, name, path, snippet, rank) of scores(id, score): texts(id, text) give a clip around the first hit, with hits in <b> marks."""
    words = "|".join(sorted(re.escape(t) for t in set(terms)))
    around = F.regexp_extract("text", rf"(?is)(?:\A|(?<=\s)).{{0,60}}?(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}]).{{0,{width}}}", 0)
    marked = F.regexp_replace(F.substring(around, 1, width), rf"(?i)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", "<b>$1</b>")
    rows = scores.join(nodes.select("id", "path"), "id").join(texts, "id")
    return rows.select("id", F.element_at(F.split("path", "/"), -1).alias("name"), "path", marked.alias("snippet"), F.col("score").cast("float").alias("rank"))


def attachment_matches(files: DataFrame, needle: str) -> DataFrame:
    """(id, path, match, page) of live files(id, path, live[, pages]): by name, or by the text of a page (pages: array of texts); a
    match by name goes first, and has no page."""
    has = lambda c: F.contains(F.lower(c), F.lit(needle.lower()))
    pages = F.col("pages") if "pages" in files.columns else F.expr("cast(null as array<string>)")
    numbers = F.filter(F.transform(pages, lambda x, i: F.when(has(x), i + 1)), lambda x: x.isNotNull())
    rows = files.filter("live").withColumn("page", F.get(numbers, 0)).withColumn("named", has(F.col("path")))
    return rows.filter(F.col("named") | F.col("page").isNotNull()).select("id", "path", F.when(F.col("named"), "name").otherwise("content").alias("match"), F.when(~F.col("named"), F.col("page")).cast("int").alias("page"))


def envelopes(workspaces: DataFrame, outcomes: DataFrame, hits: DataFrame) -> DataFrame:
    """One row a workspace that was asked, of outcomes(workspace, refused, degraded, delta): the number of its hits(workspace), none if
    it was refused, whatever befell others; an unknown delta is null; an answer for a workspace that was not asked is dropped."""
    counted = hits.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))
    rows = workspaces.select("workspace").join(outcomes, "workspace", "left").join(counted, "workspace", "left")
    refused = F.col("refused").isNotNull()
    known = F.when(F.col("delta").isin(*KNOWN_DELTA), F.col("delta"))
    return rows.select("workspace", "refused", F.coalesce("degraded", F.lit(False)).alias("degraded"), F.when(~refused, known).alias("delta"), F.when(refused, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("hits"))


def verdict(rows: DataFrame) -> DataFrame:
    """One row of envelopes(): any_hit, any_degraded, any_refused, and what no hits mean: refused over degraded over no_hits."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    one = rows.agg(any_of(F.col("hits") > 0).alias("any_hit"), any_of(F.col("degraded")).alias("any_degraded"), any_of(F.col("refused").isNotNull()).alias("any_refused"))
    return one.withColumn("verdict", search_verdict(F.col("any_refused"), F.col("any_degraded"), F.col("any_hit")))


def ask_decision() -> Column:
    """Whether a mirror's position goes with a request, for columns state, identity and unusable (a reason or null)."""
    return (
        F.when(F.col("state") == "unreadable", "state_unreadable").when(F.col("state") == "absent", "never_synced")
        .when((F.col("identity") != "ours") | F.col("unusable").isNotNull(), "unusable").otherwise("ask")
    )


def mirror_sentence() -> Column:
    """Which sentence about its mirror goes with a workspace's answer, for columns refused, decision, identity and delta; null for none: a
    refusal silences it, as does a mirror that was never synced."""
    return (
        F.when(F.col("refused").isNotNull() | (F.col("decision") == "never_synced"), None).when(F.col("decision") == "state_unreadable", "state_unreadable")
        .when((F.col("decision") == "unusable") & (F.col("identity") == "foreign"), "not_this_mirror").when(F.col("decision") == "unusable", "cannot_be_vouched_for")
        .when(F.col("delta").isin("pending", "epoch_mismatch", "rebuild_required"), F.col("delta"))
    )


def filter_problem(mounts: int, filtered: bool, outcomes: DataFrame) -> DataFrame:
    """One row (problem): a filter needs exactly one mount, and a server that answers without applying it is an error; else null."""
    ignored = outcomes.filter("refused is null and not filter_applied").limit(1).agg(F.count(F.lit(1)).alias("n"))
    if not filtered:
        return ignored.select(F.lit(None).cast("string").alias("problem"))
    return ignored.select(F.when(F.lit(mounts != 1), "needs_one_mount").when(F.col("n") > 0, "filter_not_applied").alias("problem"))


def coverage_line(counts: dict[str, Column]) -> Column:
    return F.concat_ws(", ", *(F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {k}"))) for k, c in counts.items()))


def search_verdict(refused: Column, degraded: Column, hits: Column) -> Column:
    """What a search without hits means; `hits` if there are any."""
    return F.when(hits, "hits").when(refused, "refused").when(degraded, "degraded").otherwise("no_hits")


def batches(rows: DataFrame, size: int = 16, order: str = "id") -> DataFrame:
    """rows with `batch`, their number in the order of a column divided by the size of a batch; no task sorts all of them."""
    return global_rank(rows, [F.col(order)], "_number").withColumn("batch", F.floor((F.col("_number") - 1) / size)).drop("_number")


def hit_lists(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Hits of both kinds as one table (arm, id, path, ...): the lists stay apart by their arm, and lack each other's columns."""
    return notes.withColumn("arm", F.lit("notes")).unionByName(files.withColumn("arm", F.lit("attachments")), allowMissingColumns=True)
