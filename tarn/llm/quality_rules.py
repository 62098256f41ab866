"""Quality rules as a bitmask ledger.

Every rule is evaluated once a text; the ledger, a written table, keeps the measurements and one bit a failed rule. Policies are named,
versioned sets of (mask, votes): a row is rejected if it fails a rule of the policy's veto mask, or at least `votes` rules of
its vote mask. Applying another version of a policy, or asking what a rule alone rejects, reads the ledger's bits only: no text is
measured again.

Defined cases: a null text has no words; an empty text fails few_words; texts of any length are measured whole; ids are passed
through, null and repeated ones too; an empty table gives an empty result (and an ablation of zeros); other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarn.llm.common import free_names, stored
from tarn.llm.tokens import as_bytes, slices

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_pipes")

#: Rules in bit order: name, and when it fails, as SQL on the measurements.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "n_symbols - n_pipes > 0.5 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and n_dup_lines > 0.4 * n_lines"),
    ("word_length", "word_chars > 25 * n_words or word_chars < 1.5 * n_words"),
    ("shouting", "n_upper > 0.7 * word_chars"),
    ("exclaiming", "n_marks > 0.5 * n_words"),
    ("menu", "n_pipes > 0.3 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    veto: tuple[str, ...]
    vote: tuple[str, ...] = ()
    votes: int = 2

    def rejects(self, bits: str = "fail_bits") -> Column:
        veto, vote = sum(BIT[r] for r in self.veto), sum(BIT[r] for r in self.vote)
        b = F.col(bits)
        return (b.bitwiseAND(F.lit(veto)) != 0) | (F.bit_count(b.bitwiseAND(F.lit(vote))) >= self.votes if self.vote else F.lit(False))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
#: The second version lets no row with odd words pass, and asks for nothing twice.
STRICT = Policy("standard", 2, ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "exclaiming", "menu", "word_length", "shouting"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "exclaiming", "menu"), ("word_length", "shouting"), 2)


def _repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice. Hashes find candidates; the windows themselves decide."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[2:] * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit).tolist()
    windows = [(words[i], words[i + 1], words[i + 2]) for i in at]
    seen = Counter(windows)
    covered = np.zeros(n, bool)
    where = np.array([i for i, w in zip(at, windows, strict=True) if seen[w] > 1], np.int64)
    for d in range(3):
        covered[where + d] = True
    return int(covered.sum())


_HAS_WORD = re.compile(rb"[^ \t-\r]")


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [x for x in text.split(b"\n") if _HAS_WORD.search(x)]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), _repeated_words(words), len(lines), upper, text.count(b"!"), text.count(b"|"))


def measurements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measurements): one pass over the texts."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = list(map(_measure, as_bytes(batch.column(1))))
            columns = zip(*made, strict=True) if made else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measurements, fail_bits), written once and read from then on."""
    bits = sum((F.when(F.expr(sql), F.lit(BIT[name])).otherwise(F.lit(0)) for name, sql in RULES), F.lit(0))
    return stored(measurements(df, id_col, text_col).withColumn("fail_bits", bits.cast("int")), "ledger")


def apply_policy(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Adds `kept` by the policy, from the bits alone."""
    return rows.withColumn("kept", ~policy.rejects())


def ablation(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that are rejected now but not without it.

    Rows are first counted by bit pattern (at most 2^rules of them), so the corpus is aggregated once for all rules.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for rule in (*policy.veto, *policy.vote):
        rest = Policy(policy.name, policy.version, tuple(r for r in policy.veto if r != rule), tuple(r for r in policy.vote if r != rule), policy.votes)
        failing = F.col("fail_bits").bitwiseAND(F.lit(BIT[rule])) != 0
        one = patterns.agg(
            F.coalesce(F.sum(F.when(failing, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(policy.rejects() & ~rest.rejects(), F.col("n"))), F.lit(0)).alias("n_only_by_this"),
        ).select(F.lit(f"{policy.name}-{policy.version}").alias("policy"), F.lit(rule).alias("rule"), "n_failed", "n_only_by_this")
        out = one if out is None else out.unionByName(one)
    return out


def compared(rows: DataFrame, *policies: Policy) -> DataFrame:
    """(policy, n_rows, n_kept, n_lost, n_won) of each policy over one ledger: rows it keeps, and rows that it rejects though the policy before
    it keeps them, and the other way round."""
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    out = None
    for before, policy in zip((None, *policies), policies, strict=False):
        old = before.rejects() if before else policy.rejects()
        one = patterns.agg(total(F.lit(True)).alias("n_rows"), total(~policy.rejects()).alias("n_kept"), total(policy.rejects() & ~old).alias("n_lost"), total(~policy.rejects() & old).alias("n_won"))
        one = one.select(F.lit(f"{policy.name}-{policy.version}").alias("policy"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def keep_rows(df: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that the policy keeps, all columns, in one pass and without a join."""
    names = df.columns
    at = names.index(text_col)
    *own, bits = free_names(df, *MEASURES, "fail_bits")
    renamed = dict(zip(MEASURES, own, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = list(map(_measure, as_bytes(batch.column(at))))
            columns = list(zip(*made, strict=True)) if made else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*names, *own])

    rows = df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(m, LongType()) for m in own)]))
    failed = sum((F.when(F.expr(re.sub(r"\b(n_\w+|word_chars)\b", lambda m: f"`{renamed[m[0]]}`", sql)), F.lit(BIT[name])).otherwise(F.lit(0)) for name, sql in RULES), F.lit(0))
    return rows.withColumn(bits, failed.cast("int")).filter(~policy.rejects(bits)).select(*names)
