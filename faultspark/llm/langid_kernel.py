"""Language ID by string kernels.

Blended-spectrum presence kernel: a text is the set of its 1-, 2- and 3-grams
over lower-case letters and marks of any script, all else being one sign, and
the kernel of two texts is the size of the common set over the root of the
product of their sizes. Nyström landmarks turn kernel values into features, and
one-versus-rest kernel ridge regression has a weight vector for each language.
Texts are scored by batched matrix products: presence rows over the landmarks'
n-grams, times the landmarks, times the weights.

An n-gram is exact: its code holds the code points. Texts of the letters that
the landmarks use most have their n-grams marked in a table, others sorted.

Fitting uses a bounded sample of labelled rows: about ``PER_LANGUAGE`` of each
language, at most ``SAMPLE`` in all, picked by hash from all rows that may be
learned from, and of these the ones with up to ``MOST_GRAMS`` different n-grams.
Predictions read every text whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from faultspark.llm import arrow, work

PER_LANGUAGE = 200
SAMPLE = 4000
MOST_GRAMS = 50_000
LANDMARKS = 128
RIDGE = 1e-3
SEED = 5
UND = "und"
CLASSES = 64
SIZE = CLASSES + CLASSES**2 + CLASSES**3
OTHER = 255
ROWS = 256
BLOCK = 1 << 20


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its sign: 1, or itself and 2 for letters and marks."""
    kind = np.array([ord(unicodedata.category(chr(p))[0]) for p in range(0x110000)], np.uint8)
    letter = kind == ord("L")
    return letter, np.where(letter | (kind == ord("M")), np.arange(0x110000) + 2, 1).astype(np.int64)


def _points(text: str) -> Iterator[np.ndarray]:
    """Blocks of a lower-cased text's code points; each starts with the last two before it."""
    for at in range(0, len(text), BLOCK):
        yield np.frombuffer(text[max(0, at - 2) : at + BLOCK].lower().encode("utf-32-le", "replace"), "<u4")


def has_letter(text: str) -> bool:
    return any(letters()[0][np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "replace"), "<u4")].any() for at in range(0, len(text), BLOCK))


def grams(text: str) -> np.ndarray:
    """The codes of a text's 1-, 2- and 3-grams, sorted and once each."""
    found = [np.empty(0, np.int64)]
    for points in _points(text):
        one = letters()[1][points]
        two = one[:-1] << 21 | one[1:]
        found += [np.unique(x) for x in (one, two, two[:-1] << 21 | one[2:])]
    return np.unique(np.concatenate(found))


class Spectrum:
    """N-grams of texts over a fixed list of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        signs, often = np.unique(np.concatenate([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]), return_counts=True)
        signs, often = signs[signs > 1], often[signs > 1]
        common = signs[np.argsort(-often, kind="stable")][: CLASSES - 1]
        self.table = np.where(letters()[1] > 1, OTHER, 0).astype(np.uint8)
        self.table[common - 2] = np.arange(1, len(common) + 1)
        of = np.zeros(1 << 21, np.int64)
        of[2:][: 0x110000] = self.table
        parts = [np.where(p > 0, of[p], -1) for p in (codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF)]
        place = np.where(parts[0] >= 0, CLASSES + CLASSES**2, np.where(parts[1] >= 0, CLASSES, 0))
        place = place + (np.maximum(parts[0], 0) << 12) + (np.maximum(parts[1], 0) << 6) + parts[2]
        self.tabled = ~np.any([p == OTHER for p in parts], axis=0)
        self.place = np.where(self.tabled, place, 0)
        self.row = np.zeros(SIZE, bool)

    def presence(self, text: str) -> tuple[np.ndarray, int]:
        """Which of the codes a text has, and how many different n-grams in all."""
        blocks = [self.table[p] for p in _points(text)]
        if any((b == OTHER).any() for b in blocks):
            found = grams(text)
            at = np.minimum(np.searchsorted(found, self.codes), len(found) - 1)
            return found[at] == self.codes, len(found)
        for block in blocks:
            one = block.astype(np.int32)
            two = (one[:-1] << 6) + one[1:]
            self.row[one] = True
            self.row[two + CLASSES] = True
            self.row[(two[:-1] << 6) + one[2:] + (CLASSES + CLASSES**2)] = True
        out, size = self.row[self.place] & self.tabled, int(np.count_nonzero(self.row))
        self.row[:] = False
        return out, size


class Model:
    """Kernel ridge regression on Nyström features of a sample of n-gram sets."""

    def __init__(self, sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = SEED):
        self.langs = sorted(set(langs))
        rng = np.random.default_rng(seed)
        by_lang = [rng.permutation(np.flatnonzero(np.asarray(langs) == x)) for x in self.langs]
        picked = sorted(int(i) for x in by_lang for i in x[: max(1, landmarks // len(by_lang))])
        self.grams = np.unique(np.concatenate([sets[i] for i in picked]))
        self.marks = np.stack([np.isin(self.grams, sets[i]) for i in picked], axis=1).astype(np.float32)
        self.sizes = np.sqrt(self.marks.sum(0))
        kernel = self.of_sets(sets)
        values, vectors = np.linalg.eigh(kernel[picked])
        keep = values > 1e-6 * values[-1]
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])
        z = kernel @ self.whiten
        self.mean = z.mean(0)
        target = np.where(np.asarray(langs)[:, None] == np.asarray(self.langs), 1.0, -1.0)
        self.bias = target.mean(0)
        centred = z - self.mean
        solved = np.linalg.solve(centred.T @ centred + ridge * len(z) * np.eye(z.shape[1]), centred.T @ (target - self.bias))
        self.weights = (self.whiten @ solved).astype(np.float32)
        self.offset = (self.bias - self.mean @ solved).astype(np.float32)

    def of_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of n-gram sets and the landmarks, a block of sets at a time."""
        out = [np.empty((0, len(self.sizes)))]
        for at in range(0, len(sets), ROWS):
            part = sets[at : at + ROWS]
            rows = np.stack([np.isin(self.grams, s, assume_unique=True) for s in part]).astype(np.float32)
            out.append(self.kernel(rows, np.array([len(s) for s in part])))
        return np.concatenate(out).astype(np.float64)

    def kernel(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return rows @ self.marks / (np.sqrt(np.maximum(sizes, 1))[:, None] * self.sizes)

    def scores(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.kernel(rows, sizes) @ self.weights + self.offset


def training(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: labelled, not held out, with a letter."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))


def score_floor(sets: list[np.ndarray], langs: list[str]) -> float:
    """The score under which a text is in none of the languages: halfway between 1 / L,
    which the winner of L languages has at least, and what all but 1 % of the rightly
    told texts have. Learned from every second text and read off the others."""
    model = Model(sets[::2], langs[::2]) if len(set(langs[::2])) > 1 else None
    if model is None:
        return 0.0
    got = model.of_sets(sets[1::2]) @ model.weights + model.offset
    right = [min(1.0, (1 + float(row.max())) / 2) for row, lang in zip(got, langs[1::2]) if model.langs[int(row.argmax())] == lang]
    chance = 1 / len(model.langs)
    return (chance + max(chance, float(np.quantile(right, 0.01)))) / 2 if right else 0.0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, seed: int = SEED, floor: bool = False, most_grams: int = MOST_GRAMS) -> Model | None:
    """A model of a bounded sample; None without rows to learn from.

    Rows of a language are taken by hash, at a rate that its count sets, so
    that a rare language has as many as a common one; their n-grams, not their
    texts, come to the driver. With ``floor`` the model
    has the ``score_floor`` of its sample as ``floor``."""
    rows = training(docs.select("doc_id", "text", "lang"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return None
    each = max(1, min(per_language, sample // len(counts)))
    rates = docs.sparkSession.createDataFrame([(r[0], min(2**31, int(2**31 * each / r[1]))) for r in counts], "of string, below bigint")
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(2**31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                found = grams(text.as_py())
                if len(found) <= most_grams:
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()], pa.string()), pa.array([found.tobytes()], pa.binary())], ["lang", "grams"])

    picked = work.bound_batches(rows).join(F.broadcast(rates), F.col("lang") == F.col("of")).where(drawn < F.col("below")).select("text", "lang")
    taken = sorted(picked.mapInArrow(run, "lang string, grams binary").limit(sample).collect())
    sets, langs = [np.frombuffer(r[1], np.int64) for r in taken], [r[0] for r in taken]
    model = Model(sets, langs) if taken else None
    if model and floor:
        model.floor = score_floor(sets, langs)
    return model


def predict(docs: DataFrame, model: Model | None, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of whole texts; with ``carry`` beside all columns
    of ``docs``, in which columns of those two names are replaced.

    ``und`` with score 0 where the text is null or has no letter, or where
    there was nothing to learn from. The score is half of one plus the winning
    regression value, kept between 0 and 1; ties go to the first language in
    order. Repeated rows and null ids give a row each; predictions read the
    text alone."""
    given = docs.drop("lang_pred", "score") if carry else docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    schema = StructType([*given.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names, at_text = given.columns, given.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.tidy()
        spectrum = Spectrum(model.grams) if model else None
        rows = np.zeros((ROWS, len(model.grams) if model else 0), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                langs, scores = [UND] * part.num_rows, np.zeros(part.num_rows)
                used, sizes = [], []
                for k, text in enumerate(part.column(at_text)):
                    text = text.as_py() or ""
                    if spectrum is None or not has_letter(text):
                        continue
                    rows[len(used)], size = spectrum.presence(text)
                    sizes.append(size)
                    used.append(k)
                if used:
                    got = model.scores(rows[: len(used)], np.asarray(sizes))
                    best = got.argmax(1)
                    for k, b, row in zip(used, best, got):
                        langs[k] = model.langs[b]
                        scores[k] = min(1.0, max(0.0, (1 + float(row[b])) / 2))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])
        arrow.tidy()

    told = work.bound_batches(given).mapInArrow(run, schema)
    return told if carry else told.drop("text")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = work.read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
