"""Markdown task lines: (id, text) to typed task rows.

Where checkboxes stand is a matter of the lines before them, so a small scan of each text yields its checkbox items (line, parent, mark,
body); all that a line says by itself (fields, dates, ids, hashes, tags, whether it is a task) is read from the items by Spark's own
functions.

A checkbox is a list item `[mark]` whose mark is one of CATEGORY, followed by a blank or the line's end. Items nest as lists do:
an item belongs to the nearest one whose content it is indented to, and a checkbox's parent is the nearest checkbox among those.
Front matter, fenced, indented and inline code and `%%` comments are never read. A null or empty text holds no task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Checkbox symbols and their categories, date marks, fields that make a checkbox a task.
CATEGORY = {" ": "open", "/": "in_progress", "h": "waiting", "x": "done", "X": "done", "-": "dropped"}
DATES = {"📅": "due", "⏳": "scheduled", "✅": "done"}
SIGNAL_FIELDS = ("owner", "horizon", "check", "waiting", "milestone")

_QUOTE = re.compile(r" {0,3}>[ \t]?")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_ITEM = re.compile(r"(?P<indent>[ \t]*)(?P<bullet>[-*+]|\d{1,9}[.)])(?:(?P<gap>[ \t]+)(?P<rest>.*))?$")
_BOX = re.compile(r"\[([ /hxX-])\](?:\s+(.*))?$")
_CODE = re.compile(r"\0|(`+)(?!`).+?(?<!`)\1(?!`)")

#: What a line says, in Java's syntax; a code span stands as its number between two U+0000.
_FIELD = r"(?U)(?<!\[)\[([^\[\]:]+)::\s*([^\[\]]*)\](?!\])"
_ID = r"(?U)(?:^|\s)\^([A-Za-z0-9-]+)\z"
_DATE = "(?:^|\\s)\\s*(?:" + "|".join(DATES) + ")️?\\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TAG = r"(?U)(?<![\w&#/])#([\w/-]+)"


def _front_matter(lines: list[str]) -> tuple[int, bool | None]:
    """(number of lines that the front matter takes, its boolean `tasks`); an unclosed one is no front matter."""
    if not lines or lines[0].rstrip() != "---":
        return 0, None
    for end, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            found = [m[1] == "true" for x in lines[1:end] if (m := re.fullmatch(r"tasks:\s*(true|false)\s*", x))]
            return end + 1, found[-1] if found else None
    return 0, None


def _visible(lines: list[str], first: int) -> Iterator[tuple[int, int, str]]:
    """(line number from 1, depth of quotes, text without quote marks and comments) of lines that are no fenced code."""
    fence, comment = "", False
    for number, line in enumerate(lines[first:], first + 1):
        depth = 0
        while not comment and (m := _QUOTE.match(line)):
            depth, line = depth + 1, line[m.end() :]
        if fence:
            if (m := _FENCE.match(line)) and m[1].startswith(fence) and not line[m.end() :].strip():
                fence = ""
            continue
        if not comment and (m := _FENCE.match(line)):
            fence = m[1]
            yield number, depth, ""
            continue
        kept = []
        for k, part in enumerate(line.split("%%")):
            comment = comment if k == 0 else not comment
            if not comment:
                kept.append(part)
        yield number, depth, "".join(kept).rstrip()


def checkboxes(text: str) -> list[tuple]:
    """(ordinal, parent, line, symbol, the line from its bullet, body, code spans of the body, the note's switch), in document order."""
    lines = text.replace("\r\n", "\n").split("\n")
    first, switch = _front_matter(lines)
    out: list[tuple] = []
    open_items: list[tuple[int, int | None]] = []  # (column of the item's content, ordinal of a checkbox)
    quotes, blank = 0, True
    for number, depth, line in _visible(lines, first):
        if not line.strip():
            blank = True
            continue
        if depth != quotes:
            open_items, quotes = [], depth
        indent = len(line) - len(line.lstrip()) if "\t" not in line else len(re.match(r"[ \t]*", line)[0].expandtabs(4))
        m = _ITEM.match(line)
        if not m:
            if blank:  # else it goes on with the item's paragraph
                open_items = [x for x in open_items if x[0] <= indent]
            blank = False
            continue
        while open_items and open_items[-1][0] > indent:
            open_items.pop()
        blank = False
        if indent >= (open_items[-1][0] if open_items else 0) + 4:
            continue  # indented code
        gap = len((m["gap"] or " ").expandtabs(4))
        content = indent + len(m["bullet"]) + (gap if gap <= 4 else 1)
        box = _BOX.match(m["rest"] or "")
        if box:
            parent = next((o for _, o in reversed(open_items) if o is not None), None)
            spans: list[str] = []

            def masked(code: re.Match) -> str:
                spans.append(code[0])
                return f"\0{len(spans) - 1}\0"

            body = _CODE.sub(masked, box[2] or "")
            out.append((len(out), parent, number, box[1], line.strip(), body, spans, switch))
        open_items.append((content, len(out) - 1 if box else None))
    return out


def fnv1a_of(texts: list[str]) -> list[str]:
    """fnv1a() of many texts: their bytes advance together, the longest first; the last few go on by themselves."""
    data = [t.encode() for t in texts]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-lengths, kind="stable")
    ends, left = np.cumsum(lengths), -lengths[order]
    at, flat = (ends - lengths)[order], np.frombuffer(b"".join(data), np.uint8)
    made, k = np.full(len(data), 0x811C9DC5, np.uint32), 0
    while (n := int(np.searchsorted(left, -k))) > 4:  # so many are longer than k
        made[:n] = (made[:n] ^ flat[at[:n] + k]) * np.uint32(16777619)
        k += 1
    out = made.tolist()
    for i in range(n):
        h = out[i]
        for b in data[order[i]][k:]:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        out[i] = h
    back = np.empty(len(data), np.int64)
    back[order] = np.arange(len(data))
    return [f"{out[i]:08x}" for i in back.tolist()]


ITEMS = "id long, ordinal int, parent int, line int, symbol string, hash string, body string, spans array<string>, switch boolean"
_KINDS = [pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 3, pa.list_(pa.string()), pa.bool_()]


def items(docs: DataFrame) -> DataFrame:
    """The checkbox items of docs(id, text), with the hash of the line from its bullet."""
    names = [part.split()[0] for part in ITEMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                ids, texts = (batch.column(k).slice(low, 1000).to_pylist() for k in range(2))
                rows = [(i, *item) for i, text in zip(ids, texts, strict=True) for item in checkboxes(text or "")]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                columns[5] = fnv1a_of(columns[5])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names)

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, ITEMS)


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's UTF-8, 32 bits, as eight hex digits."""
    code = F.hex(F.encode(text, "UTF-8"))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    places = F.when(code == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")))
    return F.lpad(F.lower(F.hex(F.aggregate(places, F.lit(0x811C9DC5).cast("long"), step))), 8, "0")


def _end_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _shown(text: Column) -> Column:
    """The text with its code spans."""
    numbers = F.when(F.size("spans") > 0, F.sequence(F.lit(0), F.size("spans") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, text, lambda t, k: F.replace(t, F.concat(F.lit("\0"), k.cast("string"), F.lit("\0")), F.element_at("spans", k + 1)))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def own_tags(body: Column) -> Column:
    """Tags of a line, one per tag ignoring case, the first spelling kept."""
    found = F.filter(F.transform(_all(body, _TAG, 1), lambda t: F.regexp_replace(t, "^/+|/+\\z", "")), lambda t: ~F.rlike(F.replace(t, F.lit("/"), F.lit("")), F.lit(r"(?U)^\d*\z")))
    lower = F.transform(found, F.lower)
    return F.filter(found, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def extract_tasks(docs: DataFrame) -> DataFrame:
    """One row a task of docs(id, text)."""
    rows = items(docs).withColumn("tags", own_tags(F.col("body"))).withColumn("given", F.nullif(F.regexp_extract("body", _ID, 1), F.lit("")))
    rows = rows.withColumn("rest", F.when(F.col("given").isNull(), F.col("body")).otherwise(_end_trimmed(F.regexp_replace("body", _ID, ""))))
    # dates stand at the end; one that is no day ends the reading
    rows = rows.withColumn("dated", _all(F.regexp_extract("rest", f"(?U)((?:{_DATE})*)\\z", 1), f"(?U)({_DATE})", 1))
    day = lambda x: F.regexp_extract(x, r"([0-9]{4}-[0-9]{2}-[0-9]{2})\z", 1)
    wrong = F.transform("dated", lambda x, i: F.when(day(x).try_cast("date").isNull() | F.startswith(day(x), F.lit("0000")), i + 1).otherwise(0))
    rows = rows.withColumn("dated", F.slice("dated", F.coalesce(F.array_max(wrong), F.lit(0)) + 1, F.greatest(F.size("dated"), F.lit(1))))
    rows = rows.withColumn("rest", F.when(F.size("dated") == 0, F.col("rest")).otherwise(_end_trimmed(F.expr("substring(rest, 1, char_length(rest) - char_length(array_join(dated, '')))"))))
    mark = lambda x: F.coalesce(*(F.when(F.contains(x, F.lit(k)), v) for k, v in DATES.items()))
    keys = F.transform(_all(F.col("rest"), _FIELD, 1), lambda x: _shown(_trimmed(x)))
    values = F.transform(_all(F.col("rest"), _FIELD, 2), lambda x: _shown(_trimmed(x)))
    text = _trimmed(F.regexp_replace(_shown(F.regexp_replace("rest", _FIELD, "")), r"(?U)\s+", " "))
    task = F.when(F.startswith("given", F.lit("t-")), F.col("given"))
    signal = task.isNotNull() | (F.size("dated") > 0) | F.col("symbol").isin("/", "h", "-") | F.arrays_overlap(keys, F.array(*map(F.lit, SIGNAL_FIELDS)))
    category = F.coalesce(*(F.when(F.col("symbol") == k, v) for k, v in CATEGORY.items()))
    return rows.select(
        "id", "ordinal", "parent", "line", category.alias("category"), "symbol", text.alias("text"), task.alias("task_id"), F.when(task.isNull(), F.col("given")).alias("block_id"),
        F.when(F.col("given").isNull(), F.col("hash")).alias("hash"), F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit("="), v)).alias("fields"),
        F.transform("dated", lambda x: F.concat(mark(x), F.lit("="), day(x))).alias("dates"), "tags", F.coalesce("switch", signal).alias("is_task"),
    )
