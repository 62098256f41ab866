"""Language identification in two steps: the language's family first, then its language by one-versus-one linear SVMs.

Texts are lower-cased UTF-8 with blanks for all that is no letter; features are byte trigrams, hashed to DIMS buckets, as shares of
their number. A multinomial naive Bayes model with one class a language tells the family, whose probability is the sum of its
languages'; within a family, linear SVMs (squared hinge) for each pair of languages vote, and the sum of margins breaks ties. Families
are those of FAMILIES; any other value of `lang` is a family of its own.

The models are fitted on a sample of at most about SAMPLE distinct texts a language, chosen by their hash, each whole and as a short
piece, so that short texts are learned too; each pair is a task of its own. Predictions read every text whole, in one pass.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows with a null `lang`, a null text or no letter
teach nothing; texts of any length are read whole; copies of a text count once in the sample; if nothing is learned, all
texts are `und`; with one language all others are that one; ids are passed through, null and repeated ones too; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import stored
from tarn.llm.tokens import as_bytes, chunks, slices

DIMS = 1 << 12
#: Distinct texts of a language that teach, about.
SAMPLE = 800
#: Bytes of a short piece.
PIECE = 60
#: Bytes of text whose trigrams are held at once.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "mk", "pl", "cs", "sk", "sl", "hr", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "mr", "ne", "pa", "gu", "ur"),
    "semitic": ("ar", "he"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAP = b"   "


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(bucket of each trigram, number of the first trigram's text, places where a text begins) of the texts, BLOCK bytes at a time; the
    first place is always 0. Three blanks are no trigram and have bucket DIMS."""
    kept = [t.translate(_KEPT) for t in texts]
    buf = np.frombuffer(b"".join(x for t in kept for x in (_GAP, t)) + _GAP, np.uint8).copy()
    buf[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] += 0x20
    begins = np.cumsum(np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))) - np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    for low in range(0, len(buf) - 3, BLOCK):
        some = buf[low : low + BLOCK + 2].astype(np.uint32)
        x = some[:-2] | (some[1:-1] << np.uint32(8)) | (some[2:] << np.uint32(16))
        bucket = ((x * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.intp)
        bucket[x == 0x202020] = DIMS
        first = int(np.searchsorted(begins, low, side="right")) - 1
        inner = begins[first + 1 : np.searchsorted(begins, low + len(x), side="left")] - low
        yield bucket, first, np.concatenate([[0], inner]).astype(np.intp)


def counted(texts: list[bytes]) -> np.ndarray:
    """Counts (text, bucket) of trigrams."""
    out = np.zeros((len(texts), DIMS + 1), np.float32)
    for bucket, first, places in grams(texts):
        for k, some in enumerate(np.split(bucket, places[1:])):
            out[first + k] += np.bincount(some, minlength=DIMS + 1)
    return out[:, :DIMS]


def summed(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Sums (text, column) of weights (DIMS, columns) over the trigrams of the texts; the last column counts them."""
    weights = np.pad(weights.astype(np.float32), ((0, 1), (0, 1)), constant_values=1)
    weights[DIMS] = 0
    out = np.zeros((len(texts), weights.shape[1]))
    for bucket, first, places in grams(texts):
        out[first : first + len(places)] += np.add.reduceat(weights.take(bucket, axis=0), places, axis=0)
    return out


def fit_pair(counts: np.ndarray, sign: np.ndarray, penalty: float = 1e-3, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, accelerated gradient) on shares of trigrams; a text's margin is the mean weight of its
    trigrams, plus the bias. Both sides weigh the same, whatever their numbers."""
    x = counts / counts.sum(1, keepdims=True)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    size = np.sqrt(np.mean(np.einsum("ij,ij->i", x, x)))
    x = np.column_stack([x / size, np.ones(len(x), x.dtype)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(x.dtype)
    probe = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        probe = x.T @ (share * (x @ probe))
        steep = float(np.linalg.norm(probe))
        probe /= steep
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        short = np.maximum(0, 1 - sign * (x @ ahead))
        slope = penalty * ahead - 2 * (x.T @ (share * sign * short))
        following = ahead - slope / (2 * steep + penalty)
        ahead, w = following + k / (k + 3) * (following - w), following
    return (w[:-1] * scale / size).astype(np.float32), float(w[-1])


@dataclass(frozen=True)
class Model:
    """langs: what was learned, sorted; log_shares (DIMS, langs) of trigrams in each; pairs (a, b) of places in langs within one family,
    whose SVMs' weights are (DIMS, pairs), positive for a."""

    langs: tuple[str, ...] = ()
    log_shares: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, 0), np.float32))
    pairs: tuple[tuple[int, int], ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """A language and a score of each text; texts without a trigram are UNKNOWN."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = summed(texts, np.column_stack([self.log_shares, self.weights]))
        n = np.maximum(1, sums[:, -1])
        likely = sums[:, : len(self.langs)]
        likely = np.exp(likely - likely.max(1, keepdims=True))
        likely /= likely.sum(1, keepdims=True)
        families = [family_of(x) for x in self.langs]
        names = sorted(set(families))
        inside = np.array([[f == g for g in names] for f in families], float)
        chance = likely @ inside
        family = chance.argmax(1)
        member = inside[:, family].T > 0
        votes, total, least = (np.zeros((len(texts), len(self.langs))) for _ in range(3))
        least += np.inf
        margins = sums[:, len(self.langs) : -1] / n[:, None] + self.biases
        for (a, b), m in zip(self.pairs, margins.T, strict=True):
            for side, value in ((a, m), (b, -m)):
                votes[:, side] += value > 0
                total[:, side] += value
                least[:, side] = np.minimum(least[:, side], value)
        rank = np.where(member, votes + np.tanh(total) / 4, -np.inf)
        best = rank.argmax(1)
        every = np.arange(len(texts))
        score = chance[every, family] / (1 + np.exp(-4 * np.clip(least[every, best], -50, 50)))
        return [self.langs[k] for k in best], np.clip(np.where(sums[:, -1] > 0, score, 0), 0, 1)


def _samples(rows: DataFrame) -> DataFrame:
    """(lang, key, counts) of sampled texts(lang, key, text): each whole, and a piece of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for low, high in chunks(texts):
                some = texts[low:high]
                places = [k % max(1, len(t) - PIECE) for t, k in zip(some, batch.column(1)[low:high].to_pylist(), strict=True)]
                for kind in (some, [t[p : p + PIECE] for t, p in zip(some, places, strict=True)]):
                    counts = pa.array([c.tobytes() for c in counted(kind)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], counts], ["lang", "key", "counts"])

    return rows.select("lang", "key", "text").mapInArrow(run, "lang string, key long, counts binary")


def _counts(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values(["lang", "key", "counts"])
    made = np.frombuffer(b"".join(rows["counts"]), np.float32).reshape(-1, DIMS)
    some = made.sum(1) > 0
    return rows[some], made[some]


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [_counts(rows)[1].sum(0, dtype=np.float64).astype(np.float32).tobytes()]})


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    a, b = rows["a"].iloc[0], rows["b"].iloc[0]
    rows, counts = _counts(rows)
    weights, bias = fit_pair(counts, np.where(rows["lang"] == a, 1, -1).astype(np.float32))
    return pd.DataFrame({"a": [a], "b": [b], "weights": [weights.tobytes()], "bias": [bias]})


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages of df. A row a language reaches the driver (its number of texts, its trigrams' counts), and one a pair."""
    spark = df.sparkSession
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02)).collect()
    if not sizes:
        return Model()
    limits = [(lang, (1 << 63) - 1 if n <= sample else int(sample / n * 2.0**64) - (1 << 63)) for lang, n in sizes]
    chosen = rows.join(F.broadcast(spark.createDataFrame(limits, "lang string, most long")), "lang").filter("key <= most").dropDuplicates(["lang", "key"])
    made = stored(_samples(chosen), "samples")
    totals = sorted((r["lang"], np.frombuffer(r["counts"], np.float32)) for r in made.groupBy("lang").applyInPandas(_totals, "lang string, counts binary").collect())
    langs = tuple(lang for lang, _ in totals)
    shares = np.stack([np.log((c + 0.1) / (c.sum() + 0.1 * DIMS)) for _, c in totals], 1)
    pairs = tuple((i, j) for i in range(len(langs)) for j in range(i + 1, len(langs)) if family_of(langs[i]) == family_of(langs[j]))
    if not pairs:
        return Model(langs, shares)
    sides = spark.createDataFrame([(langs[x], langs[i], langs[j]) for i, j in pairs for x in (i, j)], "lang string, a string, b string")
    fitted = made.join(F.broadcast(sides), "lang").groupBy("a", "b").applyInPandas(_fitted, "a string, b string, weights binary, bias double").collect()
    found = {(r["a"], r["b"]): r for r in fitted}
    some = [found[langs[i], langs[j]] for i, j in pairs]
    return Model(langs, shares, pairs, np.stack([np.frombuffer(r["weights"], np.float32) for r in some], 1), np.array([r["bias"] for r in some]))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""
    told = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, langs, scores = as_bytes(batch.column(1)), [], []
            for low, high in chunks(texts):
                names, values = told.value.predict(texts[low:high])
                none = [not has_letter(t.decode()) for t in texts[low:high]]
                langs += [UNKNOWN if x else name for x, name in zip(none, names, strict=True)]
                scores += np.where(none, 0.0, values).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_: Column) -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out, but teaches nothing."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))
