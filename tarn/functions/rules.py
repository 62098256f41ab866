"""Scalar rules as Column functions; no Python runs a row, except for Unicode normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Folder names that are reserved in any letter case.
RESERVED = (".obsidian", ".trash", ".git")
#: Names that agents read as instructions.
INSTRUCTION_NAMES = (
    "CLAUDE.md", "CLAUDE.local.md", "AGENTS.md", "AGENTS.override.md", "AGENT.md", "GEMINI.md", ".cursorrules", ".windsurfrules",
    ".clinerules", "copilot-instructions.md", ".claude", ".cursor", ".codex", ".gemini", ".windsurf", ".github", ".agents", ".roo",
    ".kiro", ".junie", ".continue",
)
#: Tools that only read.
READ_ONLY_TOOLS = (
    "get_current_context", "read_note", "read_notes", "read_vault", "search_notes", "list_notes", "list_tags", "notes_by_tag",
    "get_backlinks", "related_notes", "attachment_info", "read_attachment", "query_tasks", "list_fields",
)
#: The suffix of control files; a parameter of the engine.
CONTROL_SUFFIX = ".ctl"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def extension(name: Column) -> Column:
    """After the last inner dot, ASCII lower case; null if there is none."""
    return F.nullif(ascii_lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1)), F.lit(""))


def is_note_name(name: Column) -> Column:
    return F.coalesce(extension(name) == "md", F.lit(False))


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def leaf_of(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def depth_of(path: Column) -> Column:
    return F.size(segments(path)) - 1


def scope_relative(path: Column, scope: str) -> Column:
    """The path below a scope folder, '' for the folder itself, null outside."""
    return F.when(path == scope, "").when(F.startswith(path, F.lit(scope + "/")), F.substring(path, len(scope) + 2, 1 << 30))


def has_reserved_segment(path: Column) -> Column:
    return F.exists(segments(path), lambda x: ascii_lower(x).isin(*RESERVED))


def in_control_namespace(path: Column, suffix: str = CONTROL_SUFFIX) -> Column:
    return F.exists(segments(path), lambda x: F.endswith(ascii_lower(x), F.lit(suffix)))


def names_instructions(path: Column) -> Column:
    names = [n.lower() for n in INSTRUCTION_NAMES]
    return F.exists(segments(path), lambda x: ascii_lower(x).isin(*names) | ((F.octet_length(x) != F.char_length(x)) & (ascii_lower(F.upper(x)).isin(*names) | ascii_lower(F.lower(x)).isin(*names))))


def component_units(name: Column, windows: bool = False) -> Column:
    return (F.octet_length(F.encode(name, "UTF-16BE")) / 2).cast("int") if windows else F.octet_length(name)


def wikilink_expressible(name: Column) -> Column:
    return ~F.rlike(name, F.lit(r"[#|\[\]]"))


def valid_label(label: Column) -> Column:
    return F.rlike(label, F.lit(r"^[a-z0-9-]{1,64}\z"))


def parse_range(spec: Column) -> Column:
    """struct(from, to, error): A-B, A- or A; white space around the whole and each number is ignored. The first number is read first, and
    a number that is none (not_a_range) or zero (starts_at_zero) ends the reading; then backwards."""
    s = _strip(spec)
    dash = F.instr(s, "-")
    rest = F.when(dash > 0, F.substring(s, dash + 1, F.lit(1 << 30)))
    first, second = _strip(F.regexp_extract(s, r"(?s)^([^-]*)", 1)), _strip(rest)
    number = lambda c: F.when(F.rlike(c, F.lit(r"^\+?[0-9]+\z")), F.ltrim(c, F.lit("+")).try_cast("bigint"))
    fault = lambda n: F.when(n.isNull(), "not_a_range").when(n == 0, "starts_at_zero")
    a, b, open_end = number(first), number(second), rest == ""
    error = F.coalesce(fault(a), F.when((dash > 0) & ~open_end, fault(b)), F.when(b < a, "backwards"))
    return F.struct(F.when(error.isNull(), a).alias("from"), F.when(error.isNull() & ((dash == 0) | ~open_end), F.when(dash > 0, b).otherwise(a)).alias("to"), error.alias("error"))


def render_range(r: Column) -> Column:
    low, high = r["from"].cast("string"), r["to"].cast("string")
    return F.when(r["to"].isNull(), F.concat(low, F.lit("-"))).when(r["from"] == r["to"], low).otherwise(F.concat(low, F.lit("-"), high))


def sanitize(text: Column) -> Column:
    """Control characters but TAB become U+FFFD."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t]]", "�")


def sanitize_multiline(text: Column) -> Column:
    """As sanitize, but line ends LF and CR LF stay."""
    return F.regexp_replace(text, r"\r(?!\n)|[\p{Cc}&&[^\t\n\r]]", "�")


def parse_semver(version: Column) -> Column:
    """struct(major, minor, patch) of exactly x.y.z, else null."""
    p = lambda i: F.regexp_extract(version, r"^([0-9]+)\.([0-9]+)\.([0-9]+)\z", i).try_cast("bigint")
    made = F.struct(p(1).alias("major"), p(2).alias("minor"), p(3).alias("patch"))
    return F.when(p(1).isNotNull() & p(2).isNotNull() & p(3).isNotNull(), made)


def version_notice(latest: Column, current: Column) -> Column:
    """True only if both parse and latest is newer."""
    return F.coalesce(parse_semver(latest) > parse_semver(current), F.lit(False))


def _in_units(seconds: Column, n: int, before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.floor(seconds / n).cast("string"), F.lit(after))


def human_age(seconds: Column) -> Column:
    """How long ago; below a minute, and for an age below zero, "just now"."""
    made = F.when(seconds < 60, "just now")
    for below, n, unit in ((3600, 60, "m ago"), (86400, 3600, "h ago")):
        made = made.when(seconds < below, _in_units(seconds, n, "", unit))
    return made.otherwise(_in_units(seconds, 86400, "", "d ago"))


def human_until(seconds: Column) -> Column:
    """How long from now, a minute at least; "expired" where nothing is left."""
    minutes = F.greatest(seconds, F.lit(60))
    made = F.when(seconds <= 0, "expired").when(seconds < 3600, _in_units(minutes, 60, "in ", "m"))
    return made.when(seconds < 86400, _in_units(seconds, 3600, "in ", "h")).otherwise(_in_units(seconds, 86400, "in ", "d"))


def is_due(then: Column, now: Column, period: int = 86400) -> Column:
    age = now - then
    return ~((age >= 0) & (age < period))


def expires(at: Column, now: Column, skew: int = 60) -> Column:
    return F.coalesce(at <= now + skew, F.lit(False))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def sanitize_label(name: Column) -> Column:
    """Lower case; a-z0-9 stay; runs of blank, _, . and - become one -, other characters go; cut at 64, then dashes at the ends go; if
    nothing is left, project- and 8 hex digits of the name's hash."""
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"[ _.-]", "-"), "[^a-z0-9-]", ""), "-+", "-")
    cut = F.regexp_replace(F.substring(kept, 1, 64), r"^-+|-+\z", "")
    return F.when(cut != "", cut).otherwise(F.concat(F.lit("project-"), F.substring(F.sha2(name, 256), 1, 8)))


def safe_directory(handle: Column) -> Column:
    """A handle without @ before it and white space around it, as a folder's name: all but letters, digits, - and _ becomes -."""
    kept = F.regexp_replace(_strip(F.regexp_replace(handle, "^@+", "")), r"[^\p{IsAlphabetic}\p{N}_-]", "-")
    kept = F.regexp_replace(kept, r"^-+|-+\z", "")
    return F.when(kept != "", kept).otherwise("workspace")


def default_directory(handle: Column, parent: str = ".mirror") -> Column:
    """Where a workspace is mirrored if nobody says otherwise."""
    return F.concat(F.lit(parent + "/"), safe_directory(handle))


def lexical_contained(path: Column) -> Column:
    """Whether a relative path stays inside its root."""
    return ~F.startswith(path, F.lit("/")) & ~F.exists(segments(path), lambda x: x == "..")


#: Media types whose parts are not pages, and what they are called.
PART_UNITS = {
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "slide",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "sheet",
}


def unit_label(mime: Column) -> Column:
    """What a part of an attachment is called: by exactly these media types; a page for any other, and for none."""
    made = F
    for kind, unit in PART_UNITS.items():
        made = made.when(mime == kind, unit)
    return made.otherwise("page")


def same_text(a: Column, b: Column) -> Column:
    return F.replace(a, F.lit("\r\n"), F.lit("\n")) == F.replace(b, F.lit("\r\n"), F.lit("\n"))


def needs_closing_newline(text: Column) -> Column:
    return (text != "") & ~F.endswith(text, F.lit("\n"))


def tool_warrants_sync(tool: Column) -> Column:
    return ~F.element_at(F.split(tool, "__"), -1).isin(*READ_ONLY_TOOLS)


def is_write_temp(name: Column, prefix: str = ".write-") -> Column:
    return F.rlike(name, F.lit("^" + prefix.replace(".", r"\.") + r"[0-9a-f]{16}\.tmp\z"))


def is_ancestor_or_self(a: Column, b: Column) -> Column:
    return (a == b) | F.startswith(b, F.concat(a, F.lit("/")))


def render_marker(fields: dict[str, Column]) -> Column:
    """Sorted `key value` lines; an absent sha256 reads unknown."""
    return F.concat_ws("\n", *(F.concat(F.lit(k + " "), F.coalesce(c, F.lit("unknown")) if k == "sha256" else c) for k, c in sorted(fields.items())))


def parse_marker(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, " ") > 0)
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, " ", 1), F.regexp_extract(x, r"(?s)^[^ ]* (.*)\z", 1))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which the value is computed once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_ILLEGAL = r'[<>:"|?*\\\x00-\x1f]'
_ESCAPED = ["%", *'<>:"|?*\\', *map(chr, range(32))]  # the mark of an escape first
_DEVICE = r"(?is)^(con|prn|aux|nul|(com|lpt)[1-9¹²³])(\..*)?\z"


def _needs_escape(segment: Column) -> Column:
    return F.rlike(segment, F.lit(_ILLEGAL)) | F.rlike(segment, F.lit(_DEVICE)) | F.endswith(segment, F.lit(".")) | F.endswith(segment, F.lit(" "))


def encode_win_segment(segment: Column) -> Column:
    """A Windows-safe spelling; legal names are themselves."""
    return F.when(~_needs_escape(segment), segment).otherwise(_core_escape(segment))


def _core_escape(segment: Column) -> Column:
    body = segment
    for c in _ESCAPED:
        body = F.replace(body, F.lit(c), F.lit(f"%{ord(c):02X}"))
    rest = lambda x: F.substring(x, 2, 1 << 30)
    device = lambda x: F.when(F.rlike(x, F.lit(_DEVICE)), F.concat(F.lit("%"), F.hex(F.ascii(x)), rest(x))).otherwise(x)
    but_last = lambda x: F.substring(x, F.lit(1), F.char_length(x) - 1)
    end = lambda x: F.when(F.endswith(x, F.lit(".")), F.concat(but_last(x), F.lit("%2E"))).when(F.endswith(x, F.lit(" ")), F.concat(but_last(x), F.lit("%20"))).otherwise(x)
    return _let(_let(body, device), end)


def encode_win_path(path: Column) -> Column:
    return F.array_join(F.transform(segments(path), encode_win_segment), "/")


def decode_win_segment(segment: Column) -> Column:
    """The name whose encoding is exactly this spelling; any other spelling is itself."""
    parts = F.split(segment, "%")
    char = lambda x: F.concat(F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("long")), F.substring(x, 3, 1 << 30))
    after = F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.when(F.rlike(x, F.lit(r"^[0-9A-Fa-f]{2}")), char(x)).otherwise(F.concat(F.lit("%"), x)))
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(after, ""))
    held = _let(decoded, lambda x: F.when((x != segment) & _needs_escape(x) & (_core_escape(x) == segment), x).otherwise(segment))
    return F.when(F.contains(segment, F.lit("%")), held).otherwise(segment)


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Unicode normal form C, which has no built-in function.
nfc = F.pandas_udf(_nfc, StringType())


def fold_path(path: Column, ignore_case: bool = True) -> Column:
    """The key under which two names clash: NFC, then lower case with one sigma. Pure ASCII needs no normalisation."""
    made = F.when(F.octet_length(path) == F.char_length(path), path).otherwise(nfc(path))
    return F.regexp_replace(F.lower(made), "ς", "σ") if ignore_case else made


def with_fold_key(df: DataFrame, path: str = "path", name: str = "fold_key", ignore_case: bool = True) -> DataFrame:
    """df with fold_path() of a column. Only rows beyond ASCII pass through Python: the others never meet the function."""
    plain = F.octet_length(path) == F.char_length(path)
    ascii_key = F.lower(path) if ignore_case else F.col(path)
    return df.filter(plain | F.col(path).isNull()).withColumn(name, ascii_key).unionByName(df.filter(~plain).withColumn(name, fold_path(F.col(path), ignore_case)))


def geometry_key(df: DataFrame, path: str = "dir", name: str = "key", ignore_case: bool = True) -> DataFrame:
    """df with the key under which two folders are one place: lexically normal, without . and empty parts, folded where case is ignored."""
    normal = df.withColumn(name, lexical_normalize(F.col(path)))
    if not ignore_case:
        return normal
    key = "_key"
    return with_fold_key(normal, name, key).drop(name).withColumnRenamed(key, name)


def lexical_normalize(path: Column) -> Column:
    """The path without . and empty parts, and with each .. taking the part before it away; a .. with none before it stays out."""
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    parts = F.aggregate(segments(path), F.expr("cast(array() as array<string>)"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def contained_join(root: Column, path: Column) -> Column:
    """The path below a root; null for an absolute path, an empty one, and one that has a .. part."""
    inside = (path != "") & lexical_contained(path) & ~F.exists(segments(path), lambda x: x.isin("", "."))
    return F.when(inside, F.concat(root, F.lit("/"), path))


def normal_server_path(path: Column) -> Column:
    """A path as typed, for comparison with a server path: trimmed, without ./ and then slashes before it."""
    return F.regexp_replace(_strip(path), r"^(?:\./)*/*", "")


def snippet_text(s: Column) -> Column:
    """The text of highlight_runs() without its marks."""
    return F.array_join(highlight_runs(s)["text"], "")


def clip(text: Column, width: int) -> Column:
    """The text if it has at most `width` characters, else its first width - 1 and three dots."""
    return F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, max(width - 1, 0)), F.lit("...")))


def derived_marker_path(local: Column, taken: Column, control_files: tuple[str, ...] = (), max_component: int = 255, windows: bool = False) -> Column:
    """The path of a file's marker, beside it; null if its name is too long, is that of a control file, or is taken."""
    made = F.concat(local, F.lit(CONTROL_SUFFIX))
    too_long = component_units(leaf_of(made), windows) > max_component
    reserved = ascii_lower(made).isin(*[c.lower() for c in control_files]) if control_files else F.lit(False)
    return F.when(~too_long & ~reserved & ~F.coalesce(taken, F.lit(False)), made)


def relocated_marker(workspace: Column, id_: Column, folder: str = CONTROL_SUFFIX) -> Column:
    """Where a marker goes that cannot stand beside its file."""
    return F.concat(F.lit(f"{folder}/markers/"), workspace, F.lit("/"), id_, F.lit(CONTROL_SUFFIX))


def relocated_leaf(path: Column, workspace: Column, folder: str = CONTROL_SUFFIX) -> Column:
    """The leaf of a relocated marker of this workspace, named by an id; null for any other path."""
    prefix = F.concat(F.lit(f"{folder}/markers/"), workspace, F.lit("/"))
    leaf = F.substring(path, F.char_length(prefix) + 1, F.lit(1 << 30))
    named = F.rlike(leaf, F.lit(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" + CONTROL_SUFFIX.replace(".", r"\.") + r"\z"))
    return F.when(F.startswith(path, prefix) & named, leaf)


def node_marker(id_: Column, mime: Column, path: Column, sha256: Column, size: Column) -> Column:
    """The marker of an attachment: its facts as sorted lines, with the link that embeds it."""
    link = F.when(wikilink_expressible(path), F.concat(F.lit("![["), path, F.lit("]]"))).otherwise("not-expressible")
    fields = {"id": id_, "mime": F.coalesce(mime, F.lit("unknown")), "path": path, "sha256": sha256, "size": size.cast("string"), "wikilink": link}
    return F.concat(render_marker(fields), F.lit("\n"))


def highlight_runs(s: Column) -> Column:
    """array(struct(text, hit)): <b> opens where none is open, </b> closes where one is; other tags are text."""
    init = F.struct(F.lit("").alias("text"), F.lit(False).alias("on"), F.expr("cast(array() as array<struct<text:string,hit:boolean>>)").alias("runs"))
    parts = F.split(s, "(?<=</?b>)|(?=</?b>)")

    def push(acc: Column) -> Column:
        return F.when(acc["text"] == "", acc["runs"]).otherwise(F.concat(acc["runs"], F.array(F.struct(acc["text"].alias("text"), acc["on"].alias("hit")))))

    def step(acc: Column, x: Column) -> Column:
        toggles = ((x == "<b>") & ~acc["on"]) | ((x == "</b>") & acc["on"])
        return F.struct(F.when(toggles, F.lit("")).otherwise(F.concat(acc["text"], x)).alias("text"), (acc["on"] != toggles).alias("on"), F.when(toggles, push(acc)).otherwise(acc["runs"]).alias("runs"))

    return F.aggregate(parts, init, step, push)


def slice_lines(text: Column, low: Column, high: Column) -> Column:
    """Lines low to high (1-based, inclusive; null high: to the end) with their terminators."""
    lines = F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+\\z"), 0)
    return F.array_join(F.slice(lines, low, F.greatest(F.lit(0), F.least(F.coalesce(high, F.size(lines)), F.size(lines)) - low + 1)), "")


def line_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+\\z"), 0))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def front_matter_value(text: Column, key: str) -> Column:
    """A key of the front matter with its continuation lines joined by blanks; null without the key or a closed front matter."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    more = r"(?:\n(?![^\s:][^:\n]*:)(?!\s*(?:\n|\z))[^\n]*)*"
    found = F.get(F.regexp_extract_all(front, F.lit(rf"(?:\A|\n){key}:([^\n]*{more})"), 1), 0)
    return F.array_join(F.transform(F.split(found, "\n"), _strip), " ")


#: Keys of a tool call that hold a path, and those that hold several.
PATH_KEYS = ("file_path", "filePath", "notebook_path", "notebookPath", "path")
PATH_LISTS = ("file_paths", "paths")
#: Headers of a patch that name a path, at the start of a line.
PATCH_HEADERS = ("*** Add File: ", "*** Update File: ", "*** Delete File: ", "*** Move to: ")


def patch_paths(command: Column) -> Column:
    """The paths that the headers of a patch name, in order; a header after a blank is quoted text."""
    heads = "|".join(h.replace("*", r"\*") for h in PATCH_HEADERS)
    found = F.regexp_extract_all(command, F.lit(rf"(?m)^(?:{heads})([^\n]*)"), 1)
    return F.filter(F.transform(found, _strip), lambda x: x != "")


def candidate_paths(payload: Column) -> Column:
    """Every path that a tool call (JSON) is about to write, in order; remote tools write none. Other than text is skipped."""
    call = F.try_parse_json(payload)

    def text_at(v: Column, path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    def many(path: str) -> Column:
        return F.coalesce(F.try_variant_get(call, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))

    of_keys = lambda v, at: [text_at(v, f"{at}.{k}") for k in PATH_KEYS]
    edits = F.flatten(F.transform(many("$.tool_input.edits"), lambda e: F.array(*of_keys(e, "$"))))
    lists = [F.transform(many(f"$.tool_input.{k}"), lambda e: text_at(e, "$")) for k in PATH_LISTS]
    none = F.expr("cast(array() as array<string>)")
    patch = F.coalesce(patch_paths(text_at(call, "$.tool_input.command")), none)
    found = F.concat(F.array(*of_keys(call, "$.tool_input")), edits, *lists, patch)
    named = F.filter(found, lambda x: x.isNotNull() & (_strip(x) != ""))
    return F.when(F.coalesce(F.startswith(text_at(call, "$.tool_name"), F.lit("mcp__")), F.lit(False)), none).otherwise(F.coalesce(named, none))


def percent_decode(c: Column) -> Column:
    """+ is a blank; a % without two hex digits is itself."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def parse_callback(line: Column) -> Column:
    """struct(code, state, problem) of a request line `GET /callback?...`; of a repeated key the last value counts."""
    target = F.get(F.regexp_extract_all(line, F.lit(r"(?U)\S+"), 0), 1)
    pairs = F.split(F.substring(target, len("/callback?") + 1, 1 << 30), "&")

    def last(key: str) -> Column:
        own = F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == key)
        return percent_decode(F.try_element_at(F.transform(own, lambda p: F.regexp_extract(p, r"(?s)^[^=]*=(.*)\z", 1)), F.lit(-1)))

    problem = (
        F.when(target.isNull(), "malformed").when(~F.startswith(target, F.lit("/callback?")), "unexpected_path").when(last("error").isNotNull(), "refused")
        .when(last("code").isNull(), "no_code").when(last("state").isNull(), "no_state")
    )
    return F.struct(F.when(problem.isNull(), last("code")).alias("code"), F.when(problem.isNull(), last("state")).alias("state"), problem.alias("problem"))
