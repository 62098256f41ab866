"""SentencePiece vocabulary: batched Viterbi encoding, and decoding.

A text is cut at spaces; each word is its start mark (U+2581) and its UTF-8 bytes, and its segmentation is the path of
greatest total score. Distinct words of equal length advance together: at each end position the hashes of all substrings
that end there are probed in the sorted hashes of the pieces (a table of their leading bits is asked first), a vectorised
maximum stores the back pointer, and all words step back together. Long words, such as whole texts of scripts without blanks, are rarely
of one length, so they advance together by place, from substrings probed beforehand. Paths are checked against the words' bytes, so a hash that
matches by chance cannot pass. Words are cut, made distinct and put together again by numpy and Arrow, and decoding gathers
from one table of all pieces' bytes; no loop runs over words or ids of a text.

The public model file is a BPE model whose scores are merge ranks, so it has no unigram log-probabilities; a piece of rank r
scores -ln(r + 1), a byte piece BYTE_SCORE. Pieces with an inner start mark are left out; a mark that stands in the text is
encoded as bytes, so decoding is exact. Of equal totals the path whose last piece is longest is taken, at each position.

Defined cases: a null text is empty; an empty text is the lone start mark; texts and words of any length are taken whole; ids
are passed through, null and repeated ones too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.tokens import Slots, bytes_of, calls, pieces_between

MARK = "▁".encode()
BYTE_SCORE = -14.0
#: Distinct words that a worker remembers the ids of; a memory bound, results do not depend on it.
REMEMBERED = 400_000
#: Cells (words x positions) of one Viterbi call; a memory bound.
CELLS = 400_000
#: Bytes of text in one call; a longer text is a call of its own, never cut.
CALL_BYTES = 1 << 21
#: Words of more bytes than this advance together whatever their lengths, with the probes of all their places at once, so many bytes a call;
#: a longer word is a call of its own.
LONG, LONG_BYTES = 200, 1 << 20
#: Bits of the tables that tell most substrings apart from all pieces before the sorted keys are searched.
SIEVE_BITS = 18
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(991).integers(1, 2**63, 256, dtype=np.uint64)
_encoders: dict = {}


class Pieces:
    """The pieces of a model file: bytes, scores and sorted hashes by length, for word starts and for inner places."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = [-1] * 256
        self.is_byte = np.zeros(n, bool)
        self.score = np.zeros(n)
        tables: tuple[dict, dict] = ({}, {})
        rank = 0
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes[i], self.is_byte[i], self.score[i] = i, bytes([b]), True, BYTE_SCORE
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).encode()
                self.bytes[i], self.score[i] = piece, -np.log(rank + 1)
                rank += 1
                if piece.startswith(MARK) and MARK not in piece[len(MARK) :]:
                    tables[0].setdefault(len(piece), []).append(i)
                elif MARK not in piece:
                    tables[1].setdefault(len(piece), []).append(i)
        self.byte_ids = np.array(self.byte_id)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4096, np.uint64(_BASE))]))
        self.tables = tuple({length: self._sorted(ids) for length, ids in sorted(t.items(), reverse=True)} for t in tables)
        self.longest = max(self.tables[1])
        # for decoding: the bytes of all pieces one after another, a start mark as a blank
        texts = [b if self.is_byte[i] or not b.startswith(MARK) else b" " + b[len(MARK) :] for i, b in enumerate(self.bytes)]
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.text_sizes = np.array([len(b) for b in texts])
        self.text_at = np.cumsum(self.text_sizes) - self.text_sizes

    def _sorted(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted hashes, their ids, which leading bits of a hash occur)."""
        h = np.array([self.hash(self.bytes[i]) for i in ids], np.uint64)
        order = np.argsort(h)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[h >> np.uint64(64 - SIEVE_BITS)] = True
        return h[order], np.array(ids)[order], sieve

    def hash(self, b: bytes) -> int:
        total = 0
        for c in b:
            total = (total * _BASE + int(_VALUE[c])) & 0xFFFFFFFFFFFFFFFF
        return total

    @staticmethod
    def _probe(table: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of h that are keys of the table, their ids)."""
        keys, ids, sieve = table
        maybe = np.flatnonzero(sieve[h >> np.uint64(64 - SIEVE_BITS)])
        wanted = h[maybe]
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        equal = keys[at] == wanted
        return maybe[equal], ids[at[equal]]

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of words of one length (start mark included): (ids one after another, number of ids of each word)."""
        m, n = len(words), len(words[0])
        data = np.frombuffer(b"".join(words), np.uint8).reshape(m, n)
        columns = np.ascontiguousarray(data.T)
        prefix = np.zeros((n + 1, m), np.uint64)
        base = np.uint64(_BASE)
        for e in range(n):
            prefix[e + 1] = prefix[e] * base + _VALUE[columns[e]]
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        piece = np.full((n + 1, m), -1, np.int32)
        for e in range(len(MARK), n + 1):
            top, chosen = best[e], piece[e]
            options = [(0, self.tables[0][e])] if e in self.tables[0] else []
            options += [(e - length, self.tables[1][length]) for length in range(min(self.longest, e - len(MARK)), 0, -1) if length in self.tables[1]]
            for s, table in options:
                here, found = self._probe(table, prefix[e] - prefix[s] * self.powers[e - s] if s else prefix[e])
                total = best[s, here] + self.score[found]
                better = total > top[here]
                here = here[better]
                top[here], chosen[here] = total[better], found[better]
            if e > len(MARK):
                total = best[e - 1] + BYTE_SCORE
                better = np.flatnonzero(total > top)
                top[better], chosen[better] = total[better], self.byte_ids[columns[e - 1, better]]
        steps, ends, live = [], np.full(m, n), np.arange(m)
        while len(live):  # all words step back together
            found = piece[ends[live], live]
            steps.append((live, found))
            ends[live] -= self.sizes[found]
            live = live[ends[live] > 0]
        owner = np.concatenate([w for w, _ in steps[::-1]])
        order = np.argsort(owner, kind="stable")
        ids, counts = np.concatenate([f for _, f in steps[::-1]])[order], np.bincount(owner, minlength=m)
        if not np.array_equal(self._spelled(ids), data.reshape(-1)):  # a hash matched by chance
            paths = [self.segment_slowly(w) for w in words]
            ids, counts = np.array([i for p in paths for i in p]), np.array([len(p) for p in paths])
        return ids, counts

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces, start marks as they are."""
        return np.frombuffer(b"".join(map(self.bytes.__getitem__, ids.tolist())), np.uint8)

    def segment_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """segment() for words of any lengths, which advance together all the same: the substrings of one length, of all words, are probed at
        once; then each step takes the pieces that end at its place in every word that is that long."""
        words, back = sorted(words, key=len, reverse=True), np.argsort(sorted(range(len(words)), key=lambda i: -len(words[i])), kind="stable")
        sizes = np.array(list(map(len, words)))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(data)) - starts[word]
        remaining = sizes[word] - offset
        # hash of [s, e) is prefix[e] - prefix[s] * base^(e - s); prefixes come from sums of value * base^-place, which need no loop
        up, down = np.full(len(data) + 1, np.uint64(_BASE)), np.full(len(data) + 1, np.uint64(pow(_BASE, -1, 2**64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * down[1:])])
        begins, found, lengths = [], [], []
        for mark, tables in ((True, self.tables[0]), (False, self.tables[1])):
            for length, table in tables.items():
                low = starts[sizes >= length] if mark else np.flatnonzero((offset >= len(MARK)) & (remaining >= length))
                here, ids = self._probe(table, (total[low + length] - total[low]) * up[low + length])
                begins.append(low[here]), found.append(ids), lengths.append(np.full(len(here), length))
        begin, ids, length = (np.concatenate(x) for x in (begins, found, lengths))
        owner, end = word[begin], offset[begin] + length
        order = np.lexsort((begin, owner, end))  # by place; in a word the longest piece first
        begin, ids, owner, end = begin[order], ids[order], owner[order], end[order]
        upto = np.searchsorted(end, np.arange(sizes[0] + 2))
        group = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (end[1:] != end[:-1])]) if len(owner) else np.zeros(0, bool))
        of = np.searchsorted(group, upto)
        slot = starts + np.arange(len(words))  # of a word's place 0; it has one more than bytes
        best = np.full(len(data) + len(words), -np.inf)
        best[slot] = 0
        piece = np.full(len(best), -1, np.int64)
        at, gain = begin + owner, self.score[ids]
        long = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="right")  # how many words have that many bytes
        for e in range(len(MARK), sizes[0] + 1):
            places = slot[: long[e]] + e
            low, high = upto[e], upto[e + 1]
            if high > low:
                sums = best[at[low:high]] + gain[low:high]
                groups = group[of[e] : of[e + 1]] - low
                top = np.maximum.reduceat(sums, groups)
                first = np.where(sums == np.repeat(top, np.diff(np.append(groups, high - low))), np.arange(high - low), high)
                chosen = np.minimum.reduceat(first, groups)
                where = slot[owner[low:high][groups]] + e
                real = top > -np.inf
                best[where[real]], piece[where[real]] = top[real], ids[low:high][chosen[real]]
            if e > len(MARK):
                step = best[places - 1] + BYTE_SCORE
                better = step > best[places]
                best[places[better]] = step[better]
                piece[places[better]] = self.byte_ids[data[starts[: long[e]][better] + e - 1]]
        steps, ends, live = [], sizes.copy(), np.arange(len(words))
        while len(live):  # all words step back together
            taken = piece[slot[live] + ends[live]]
            steps.append((live, taken))
            ends[live] -= self.sizes[taken]
            live = live[ends[live] > 0]
        whose = np.concatenate([w for w, _ in steps[::-1]])
        ids, counts = np.concatenate([f for _, f in steps[::-1]])[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))
        if not np.array_equal(self._spelled(ids), data):  # a hash matched by chance
            paths = [self.segment_slowly(w) for w in words]
            ids, counts = np.array([i for p in paths for i in p]), np.array([len(p) for p in paths])
        cut = np.split(ids, np.cumsum(counts)[:-1])
        return np.concatenate([cut[i] for i in back]), counts[back]

    def segment_slowly(self, word: bytes) -> list[int]:
        """The same path for one word, by its bytes."""
        if not hasattr(self, "spelled"):
            self.spelled = [{self.bytes[i]: i for _, ids, _ in t.values() for i in ids} for t in self.tables]
        n = len(word)
        best: list[tuple[float, int]] = [(0.0, -1)] + [(-np.inf, -1)] * n
        for e in range(len(MARK), n + 1):
            for s in [0, *range(max(len(MARK), e - self.longest), e)]:
                i = self.spelled[0 if s == 0 else 1].get(word[s:e])
                if i is not None and best[s][0] + self.score[i] > best[e][0]:
                    best[e] = (best[s][0] + self.score[i], i)
            if e > len(MARK) and best[e - 1][0] + BYTE_SCORE > best[e][0]:
                best[e] = (best[e - 1][0] + BYTE_SCORE, self.byte_id[word[e - 1]])
        path, e = [], n
        while e > 0:
            path.append(best[e][1])
            e -= len(self.bytes[best[e][1]])
        return path[::-1]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids: a blank for each start mark, the first one included."""
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        return self.text_bytes[np.repeat(self.text_at[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes and decodes whole batches of texts; remembers distinct words."""

    def __init__(self, path: str):
        self.pieces, self.known = Pieces(path), Slots(REMEMBERED)

    def _learn(self, new: list[bytes]) -> None:
        """new: words, each with the blank before it."""
        by_length: dict[int, list[bytes]] = {}
        long: list[bytes] = []
        for w in new:
            if len(w) - 1 + len(MARK) > LONG:
                long.append(w)
            else:
                by_length.setdefault(len(w), []).append(w)
        low = 0
        while low < len(long):
            high, size = low + 1, len(long[low])
            while high < len(long) and size + len(long[high]) <= LONG_BYTES:
                size, high = size + len(long[high]), high + 1
            self.known.append(long[low:high], *self.pieces.segment_long([MARK + w[1:] for w in long[low:high]]))
            low = high
        for length, some in by_length.items():
            n = length - 1 + len(MARK)
            step = max(1, CELLS // n)
            for low in range(0, len(some), step):
                part = some[low : low + step]
                self.known.append(part, *self.pieces.segment([MARK + w[1:] for w in part]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text, the texts' bytes with a blank before each, their ends)."""
        buf, ends = bytes_of(texts)
        n = len(ends)
        marked = np.insert(buf, ends - np.diff(ends, prepend=0), 32)  # a blank before each text
        ends = ends + np.arange(1, n + 1)
        begins = np.flatnonzero(marked == 32)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), marked, ends
        distinct, number = pieces_between(marked, begins)
        ids, upto = self.known.gathered(self.known.slots(distinct, self._learn)[number])
        cuts = upto[np.searchsorted(begins, ends, side="left")]
        return ids, np.diff(cuts, prepend=0), marked, ends

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts with a blank before each, their ends)."""
        ends = np.concatenate([[0], np.cumsum(self.pieces.text_sizes[ids])])[np.cumsum(counts)]
        return self.pieces.decode(ids), ends


def encoder_for(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_path)
        for batch in batches:
            for low, high in calls(bytes_of(batch.column(1))[1], CALL_BYTES):
                some = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([some.column(0), _lists(*encoder.encode(some.column(1))[:2])], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                lists = some.column(1)
                counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                data, ends = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                raw = data.tobytes()
                texts = [raw[a + 1 : b].decode() if x.is_valid else None for x, a, b in zip(lists, [0, *ends.tolist()], ends.tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _equal(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray, wanted_ends: np.ndarray) -> list[bool]:
    """Whether each text of `data` is that of `wanted`."""
    if np.array_equal(ends, wanted_ends) and np.array_equal(data, wanted):
        return [True] * len(ends)
    at, of = [0, *ends.tolist()], [0, *wanted_ends.tolist()]
    return [np.array_equal(data[at[i] : at[i + 1]], wanted[of[i] : of[i + 1]]) for i in range(len(ends))]


def encode_and_check(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, ids_crc32, decoded_equal, ids): each text encoded, decoded again and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_path)
        for batch in batches:
            for low, high in calls(bytes_of(batch.column(1))[1], CALL_BYTES):
                some = batch.slice(low, high - low)
                ids, counts, marked, ends = encoder.encode(some.column(1))
                equal = _equal(*encoder.decode(ids, counts), marked, ends)
                cuts = [0, *np.cumsum(counts).tolist()]
                n_bytes = np.concatenate([[0], np.cumsum(encoder.pieces.is_byte[ids])])
                plain = ids.astype("<u4")
                crc = [zlib.crc32(plain[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                arrays = [some.column(0), pa.array(counts, pa.int64()), pa.array(np.diff(n_bytes[cuts]), pa.int64()), pa.array(crc, pa.int64()), pa.array(equal), _lists(ids, counts)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_equal", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_equal boolean, ids array<int>")
