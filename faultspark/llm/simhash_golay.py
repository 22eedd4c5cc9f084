"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in at most two bits agree in one segment (pigeonhole), and differ by at most
two bits in each other one. The binary Golay code of length 23 has all words
within distance 3 of exactly one codeword; two words that differ in two bits
have a word between them, whose codeword is within distance 4 of both. So the
codewords within distance 4 of a segment (one, or six) are its fuzzy keys, and
a key here is an equal segment with a fuzzy key of the next one. Pairs that
share a key are verified by their bits.

Buckets of more than ``LIMIT`` fingerprints are not paired. Their fingerprints
are met exactly in another way: each emits itself and its 64 one-bit changes,
and all that emit the same value are within two bits of each other, so a star
around the smallest of them holds every link's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm import arrow, work
from faultspark.llm.components import components

WORDS = 3
SEED = 42
BITS = 2
LIMIT = 64
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BLOCK = 1 << 16


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned SimHash of a text's bytes; zero without words."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = tokens[at : at + BLOCK + words - 1]
        if len(part) <= words:
            grams = [b" ".join(part)]
        else:
            grams = map(b" ".join, zip(*(part[k:] for k in range(words))))
        h = np.array([digest(g, seed) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _syndrome(x: np.ndarray) -> np.ndarray:
    out, power = np.zeros(x.shape, np.int64), 1
    for bit in range(23):
        out ^= np.where(x >> bit & 1, power, 0)
        power <<= 1
        if power >> 11:
            power ^= GENERATOR
    return out


def near_table() -> np.ndarray:
    """For each syndrome, the errors of weight up to 4 that have it, as a row of
    six; a row of one error repeats it."""
    errors = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    order = np.argsort(_syndrome(errors), kind="stable")
    where = _syndrome(errors)[order]
    begin = np.searchsorted(where, np.arange(2048))
    count = np.searchsorted(where, np.arange(2048), side="right") - begin
    return errors[order][begin[:, None] + np.minimum(np.arange(6), count[:, None] - 1)]


def fuzzy_keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of 23-bit words."""
    return (words[:, None] ^ table[_syndrome(words)]) >> 11


def bucket_keys(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of unsigned fingerprints, and for each the row it is of."""
    parts = [(prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys, rows = [], []
    for k, part in enumerate(parts):
        fuzzy = fuzzy_keys(parts[(k + 1) % 3], table)
        fresh = np.ones(fuzzy.shape, bool)
        fresh[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
        key = (np.int64(k) << 34 | part[:, None] << 12 | fuzzy)[fresh]
        keys.append(key)
        rows.append(np.nonzero(fresh)[0])
    return np.concatenate(keys), np.concatenate(rows)


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) of whole texts, print as a signed long; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.tidy()
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in arrow.text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])
        arrow.tidy()

    return work.bound_batches(docs).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, print bigint")


def _keys(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = near_table()
        for batch in batches:
            prints = batch.column(0).to_numpy()
            keys, rows = bucket_keys(prints.view(np.uint64), table)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], ["key", "print"])

    return distinct.select("print").mapInArrow(run, "key bigint, print bigint")


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within two bits."""
    keys = work.cut(_keys(distinct), "keys")
    sizes = work.cut(keys.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = work.cut(keys.join(sizes, F.col("key") == F.col("bucket")).select("key", "print", "n"), "shared")
    light = shared.where(F.col("n") <= limit)
    a, b = light.select("key", F.col("print").alias("u")), light.select(F.col("key").alias("other"), F.col("print").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS)
    paired = a.join(b, (F.col("key") == F.col("other")) & near).select("u", "v")
    one_bit = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    heavy = shared.where(F.col("n") > limit).select("print").distinct()
    around = work.cut(heavy.select("print", F.explode(one_bit).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("meet")), "around")
    least = around.groupBy(F.col("meet").alias("point")).agg(F.min("print").alias("u"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, F.col("meet") == F.col("point")).where("print <> u").select("u", F.col("print").alias("v"))
    return paired.union(stars)


def near_groups(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, print and component_id, the smallest doc_id reachable by links.

    Null and empty texts have print zero and are linked like any other. Rows
    with a null doc_id take part; their component_id is the smallest non-null
    one, or null. Repeated rows give a row each; an empty table gives none.
    Only the two named columns are read."""
    prints = work.cut(fingerprints(docs, words, id_col, text_col), "prints")
    distinct = work.cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, limit))
    rooted = work.cut(distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root")), "rooted")
    ids = rooted.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    named = work.cut(rooted.join(ids, F.col("root") == F.col("top")).select(F.col("print").alias("named"), "component_id"), "named")
    return prints.join(named, F.col("print") == F.col("named"), "left").select("doc_id", "print", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(work.read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
