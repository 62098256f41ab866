"""Token ids in canonical length-limited Huffman code.

The texts are dealt to ranges of ascending ids and tokenized once, into a scratch table of blocks of whole documents (16 bits an
id where the vocabulary allows). Its histogram, at most one row an id of the vocabulary, gives the code lengths by
package-merge on the driver; a map over the scratch blocks then encodes them, and the scratch table is dropped. A block is
independent: its ids decode from the codebook alone, and its checkpoints (bit offsets each CHECK ids) let all lanes of many
blocks advance together by one table lookup a step.

File format: Parquet rows (part, block, doc_ids, n_tokens, payload, checkpoints); parts and blocks in order hold documents in
ascending order; the codebook is a table (id, length).

Defined cases: a null text is empty and holds the end id only; null ids come first; rows that repeat an id follow one another
in the order of the input; a text of any length is tokenized whole and
stands in one block; a text that holds an added token's mark gets the ids that the library gives it; an empty table gives no
blocks; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import drop_path, new_path
from tarn.llm.tokens import Slots, bytes_of, calls, pieces_between, slices

MAX_LENGTH = 18
CHECK = 256
BLOCK_TOKENS = 65_536
END_ID = 0
#: Pieces of text that a worker remembers the ids of (some 150 bytes each); a memory bound, results do not depend on it.
REMEMBERED = 400_000
#: Bytes of text that are tokenized in one call; a longer text is a call of its own, never cut.
CALL_BYTES = 1 << 21
#: Kinds of bytes. ACCENT begins U+00C0 to U+00FF; it and all kinds above begin characters that are never white space.
SPACE, NEW_LINE, ACCENT, OTHER_VISIBLE, LETTER, MARK = 1, 2, 3, 4, 5, 6
KIND = np.zeros(256, np.int8)
KIND[33:127] = MARK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[39, *range(48, 58)]] = OTHER_VISIBLE  # digits, and the apostrophe, which may begin a contraction
KIND[32], KIND[10], KIND[0xC3] = SPACE, NEW_LINE, ACCENT
VISIBLE = frozenset(bytes([b]) for b in np.flatnonzero(KIND >= ACCENT).tolist())
#: Text after which a piece that begins with a visible character stands as at the start of a text.
APART = b" a\n"

_tokenizers: dict = {}


class PieceTokenizer:
    """The tokenizers library over the distinct pieces of many texts at once.

    A byte-level pre-tokenizer always breaks before a space that a visible character follows, between an ASCII letter and a mark,
    and after a single line end between visible characters, so text cut there gets the same ids in pieces as in one. Pieces are found and made distinct as bytes, by numpy and Arrow; new ones are joined, encoded together
    and told apart by the byte lengths of their ids. No loop runs over the places of pieces in the texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # words, with or without a blank before them, are pre-tokens: for them lines are enough, and the pattern need not run
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.id_bytes = np.zeros(self.size, np.int64)
        self.id_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a byte-level piece has a character a byte
        self.known = Slots(REMEMBERED)

    def _learn(self, new: list[bytes]) -> None:
        words, rest = [], []
        for p in new:
            (words if _is_word(p) else rest).append(p)
        spaced = [p for p in rest if p[0] == 32 and p[1:2] in VISIBLE]
        bare = [p for p in rest if p[:1] in VISIBLE]
        alone = [p for p in rest if p[:1] not in VISIBLE and (p[0] != 32 or p[1:2] not in VISIBLE)]
        for some in _parts(alone):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
            self.known.append(some, np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        for some in _parts(words):
            ids = self._joined(self.words, b"\n".join(some))
            self.known.append(some, ids, self._sizes(ids, np.fromiter(map(len, some), np.int64, len(some))))
        for pieces, before in ((spaced, b""), (bare, APART)):
            for some in _parts(pieces):
                ids = self._joined(self.tokenizer, before + before.join(some))
                lengths = np.full(2 * len(some), len(before), np.int64)
                lengths[1::2] = np.fromiter(map(len, some), np.int64, len(some))
                sizes = self._sizes(ids, lengths)
                own = np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)
                self.known.append(some, ids[own], sizes[1::2])

    @staticmethod
    def _joined(tokenizer, text: bytes) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _sizes(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many of the ids spell each of the consecutive stretches of the given lengths in bytes."""
        return np.diff(np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(lengths), side="right"), prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; number of ids of each text); null is empty. Texts are read in place."""
        buf, ends = bytes_of(texts)
        lengths = np.diff(ends, prepend=0)
        begin = np.zeros(len(buf), bool)
        if len(buf) > 1:
            kind = KIND[buf]
            here, follows = kind[:-1], kind[1:]
            begin[:-1] = (here == SPACE) & (follows >= ACCENT)
            begin[1:] |= (here == LETTER) & (follows == MARK)
            begin[2:] |= (kind[:-2] >= OTHER_VISIBLE) & (here[1:] == NEW_LINE) & (follows[1:] >= ACCENT)
        begin[(ends - lengths)[lengths > 0]] = True
        begins = np.flatnonzero(begin)
        slots = np.zeros(0, np.int64)
        if len(begins):
            distinct, number = pieces_between(buf, begins)
            slots = self.known.slots(distinct, self._learn)[number]
        flat, upto = self.known.gathered(slots)
        cuts = upto[np.searchsorted(begins, ends, side="left")]  # ids before the end of each text
        ids, counts = np.insert(flat, cuts, END_ID), np.diff(cuts, prepend=0) + 1
        return self._with_marks(texts, ids, counts)

    def _with_marks(self, texts: pa.Array, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, but texts that hold an added token's mark (such as <|endoftext|>) are encoded whole, by the library alone."""
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return ids, counts
        own = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(marked).tolist():
            own[i] = np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, END_ID], np.uint32)
        return np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))


def _is_word(piece: bytes) -> bool:
    """Whether a piece is letters up to U+00FF, with or without a blank before them."""
    word = piece[1:] if piece[0] == 32 else piece
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and max(text) < "\u0100"


def _parts(pieces: list[bytes], size: int = 500) -> Iterator[list[bytes]]:
    for low in range(0, len(pieces), size):
        yield pieces[low : low + size]


def tokenizer_for(path: str) -> PieceTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for the given counts (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, items = [], leaves
    levels.append(np.ones(n, bool))
    for _ in range(limit - 1):
        even = len(items) // 2 * 2
        merged = np.concatenate([leaves, items[0:even:2] + items[1:even:2]])
        by_weight = np.argsort(merged, kind="stable")
        items = merged[by_weight]
        levels.append(by_weight < n)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        m = int(is_leaf[:take].sum())
        lengths[order[:m]] += 1
        take = 2 * (take - m)
    return lengths


class Codebook:
    """Canonical codes: ids in order of (length, id) get consecutive codes."""

    def __init__(self, lengths: np.ndarray, limit: int = MAX_LENGTH):
        self.lengths, self.limit = lengths, limit
        used = np.flatnonzero(lengths)
        ordered = used[np.lexsort((used, lengths[used]))]
        spans = (1 << (limit - lengths[ordered])).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(spans)])[:-1]
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ordered] = (begins >> (limit - lengths[ordered])).astype(np.uint64)
        self.coded = self.codes << np.uint64(8) | lengths.astype(np.uint64)  # a code and its length, for one look-up an id
        # the same for decoding: by the next `limit` bits, the id and its length
        self.table = np.zeros(1 << limit, np.uint32)
        filled = np.repeat(ordered << 5 | lengths[ordered], spans)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[int]]:
        """(payload, bit offset of each CHECK-th id)."""
        if not len(ids):
            return bytes(8), []
        coded = self.coded[ids]
        size = (coded & np.uint64(255)).astype(np.int32)
        if not size.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(size, dtype=np.int64)
        at = ends - size
        place = at >> 5
        words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
        value = (coded >> np.uint64(8)) << (64 - size - (at & 31)).astype(np.uint64)
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        merged = np.bitwise_or.reduceat(value, begins)
        first = place[begins]
        words[first] |= merged >> np.uint64(32)
        words[first + 1] |= merged & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes(), at[::CHECK].tolist()

    def decode(self, blocks: list[tuple[bytes, list[int], int]]) -> list[np.ndarray]:
        """ids of each (payload, checkpoints, number of ids); lanes of all blocks advance together, the longest first."""
        base = np.cumsum([0, *(len(p) for p, _, _ in blocks)])
        data = np.frombuffer(b"".join(p for p, _, _ in blocks) + b"\0" * 4, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = np.array([8 * int(b) + c for b, (_, cs, _) in zip(base, blocks, strict=False) for c in cs], np.int64)
        left = np.array([min(CHECK, n - CHECK * k) for _, cs, n in blocks for k in range(len(cs))], np.int64)
        lanes = np.argsort(-left, kind="stable")
        at = at[lanes]
        out = np.zeros((CHECK, len(at)), np.uint32)
        mask, shift = np.uint32((1 << self.limit) - 1), np.uint32(32 - self.limit)
        live = np.searchsorted(-left[lanes], -np.arange(CHECK), side="left").tolist()  # lanes with more than `step` ids
        for step, n in enumerate(live):
            if not n:
                break
            o = at[:n]
            found = self.table[(window[o >> 3] >> (shift - (o & 7).astype(np.uint32))) & mask]
            out[step, :n] = found
            o += found & np.uint32(31)
        whole = np.empty((len(lanes), CHECK), np.uint32)
        whole[lanes] = (out >> np.uint32(5)).T
        result, lane = [], 0
        for _, cs, n in blocks:
            result.append(whole[lane : lane + len(cs)].reshape(-1)[:n])
            lane += len(cs)
        return result


BLOCKS = "part int, block int, doc_ids array<long>, n_tokens array<int>, payload binary, checkpoints array<int>"
SCRATCH = "part int, block int, doc_ids array<long>, n_tokens array<int>, ids binary, width int"
#: The block number of a part's histogram row: how often each id occurs in the part, as 64-bit counts in `ids`.
HISTOGRAM = -1


def token_blocks(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """SCRATCH blocks of (doc_id, text) rows, in the rows' order within their partition, and each partition's histogram row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_for(tokenizer_path)
        kind = np.dtype("<u2" if t.size <= 1 << 16 else "<u4")
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, sizes, made, held = [], [], [], 0
        total = np.zeros(t.size, np.int64)

        def batch_of(*row) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], ["part", "block", "doc_ids", "n_tokens", "ids", "width"])

        def emit() -> pa.RecordBatch:
            nonlocal doc_ids, sizes, made, held, block
            row = batch_of(part, block, doc_ids, sizes, np.concatenate(made).tobytes(), kind.itemsize)
            doc_ids, sizes, made, held, block = [], [], [], 0, block + 1
            return row

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in calls(bytes_of(texts)[1], CALL_BYTES):
                ids, counts = t.encode(texts.slice(low, high - low))
                total += np.bincount(ids, minlength=t.size)
                ids, at = ids.astype(kind), 0
                for key, n in zip(keys[low:high], counts.tolist(), strict=True):
                    doc_ids.append(key), sizes.append(n), made.append(ids[at : at + n])
                    at, held = at + n, held + n
                    if held >= BLOCK_TOKENS:
                        yield emit()
        if made:
            yield emit()
        yield batch_of(part, HISTOGRAM, [], [], total.astype("<i8").tobytes(), 8)

    return rows.mapInArrow(run, SCRATCH)


def _ids_of(payload: bytes, width: int) -> np.ndarray:
    return np.frombuffer(payload, f"<u{width}")


def count_ids(blocks: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, the end ids included; summed from the histogram rows of SCRATCH blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                own = np.frombuffer(payload, "<i8")
                total = own if not len(total) else total + own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    return blocks.filter(F.col("block") == HISTOGRAM).select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text) in ranges of ascending ids. Rows that share an id (or have none) go by their place in the input, so that
    any number of them is dealt to several parts."""
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "_place")
    return dealt.sortWithinPartitions("doc_id", "_place").select("doc_id", "text")


def write_tokens(df: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> str:
    """Encode every text and write the files; returns their path."""
    spark = df.sparkSession
    path = path or new_path(spark, "tokens")
    scratch = new_path(spark, "token_blocks")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    token_blocks(_dealt(rows, parts), tokenizer_path).write.option("compression", "zstd").parquet(scratch)
    blocks = spark.read.schema(SCRATCH).parquet(scratch)
    counts = {r["id"]: r["n"] for r in count_ids(blocks).collect()}  # at most the vocabulary
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    lengths = code_lengths(dense)
    spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths) if n], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        for batch in batches:
            for some in slices([batch], 16):
                made = [book.encode(_ids_of(ids.as_py(), width.as_py())) for ids, width in zip(some.column(4), some.column(5), strict=True)]
                columns = [pa.array([p for p, _ in made], pa.binary()), pa.array([c for _, c in made], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], *columns], ["part", "block", "doc_ids", "n_tokens", "payload", "checkpoints"])

    blocks.filter(F.col("block") != HISTOGRAM).mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    drop_path(spark, scratch)
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files."""
    lengths = {r["id"]: r["length"] for r in spark.read.schema("id int, length int").parquet(f"{path}/codebook").collect()}  # at most the vocabulary
    dense = np.zeros(max(lengths, default=0) + 1, np.int64)
    dense[list(lengths)] = list(lengths.values())
    shared = spark.sparkContext.broadcast(dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for low in range(0, len(rows), 16):
                some = rows[low : low + 16]
                out = []
                for (part, block, doc_ids, ns, _, _), ids in zip(some, book.decode([(p, c, sum(ns)) for _, _, _, ns, p, c in some]), strict=True):
                    ends = np.cumsum(ns)
                    for doc_id, n, end in zip(doc_ids, ns, ends.tolist(), strict=True):
                        own = ids[end - n : end].astype("<u4")
                        out.append((part, block, doc_id, end - n, n, zlib.crc32(own.tobytes()), own if with_ids else None))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"])

    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    docs = stored.mapInArrow(run, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids array<long>")
    sizes = stored.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("block_start")).join(parts, "part")
    out = docs.join(starts, ["part", "block"])
    columns = ["doc_id", (F.col("part_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*columns, *(["ids"] if with_ids else []))
