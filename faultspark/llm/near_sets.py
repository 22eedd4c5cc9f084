"""Near-duplicate documents: sets of word shingles with a Jaccard similarity of
``SIMILAR`` or more, found as candidates and verified exactly.

Candidates are the Golay-code links of the sets' SimHash fingerprints (see
``simhash_golay``) and pairs that share one of ``BANDS`` keys of ``ROWS``
min-hashes each: at a similarity of 0.8 the bit distance is 6 to 15, which no
number of equal segments finds, while a band is shared but for one pair in
(1 - 0.8^4)^16, some 2 in 10,000. Equal sets are one set from the start.

Pairs are made in three rounds, and from the second on only between different
components, so that a large group of near copies costs a few pairs for each of
them. First each set of a bucket is compared to the bucket's smallest. Then sets
outside the component that has most of a bucket are paired with the bucket's
sets of other components, if their min-hashes differ in ``NEAR`` of 64 places at
most, as those of half of the similar pairs do. What is left of buckets with
several components meets by prefixes: of similar sets, the rarest fifth of
either's shingles and one more must share one, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultspark.llm import arrow, simhash_golay, work
from faultspark.llm.components import components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
NEAR = 12
SEED = 42
BLOCK = 1 << 12


def shingles(data: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted hashes of a text's different shingles; a text of fewer words is one shingle."""
    tokens = data.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    return np.unique(np.array([digest(g, seed) for g in grams], np.uint64))


def simhash(found: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), BLOCK):
        ones += np.unpackbits(found[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def minima(found: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[at : at + BLOCK, None] ^ mixers[0]) * mixers[1]).min(0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A signed key for each band of min-hashes."""
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def planes(least: np.ndarray) -> np.ndarray:
    """Four bits of each min-hash, the same bit of all in one word."""
    return np.packbits([least >> np.uint64(20 + k) & np.uint64(1) for k in range(4)], axis=1, bitorder="little").view("<i8")[:, 0]


def _sig(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, n, print, bands, planes): a text's set by its hash, size, fingerprint, keys and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.tidy()
        mixers = _mixers()
        for batch in batches:
            sets = [shingles(t) for t in arrow.text_bytes(batch.column(1))]
            least = [minima(s, mixers) for s in sets]
            columns = [pa.array([f(s) for s in sets], pa.int64()) for f in (_sig, len, simhash)]
            columns += [pa.array([bands(m) if len(s) else [] for s, m in zip(sets, least)], pa.list_(pa.int64())), pa.array([planes(m) for m in least], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "sig", "n", "print", "bands", "planes"])
        arrow.tidy()

    return docs.mapInArrow(run, "doc_id bigint, sig bigint, n bigint, print bigint, bands array<bigint>, planes array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.tidy()
        for batch in batches:
            sets = [shingles(t) for t in arrow.text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([_sig(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["of", "held"])
        arrow.tidy()

    return docs.mapInArrow(run, "of bigint, held array<bigint>")


def _verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (u, v) of set hashes that are similar."""
    pairs = work.cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "pairs")
    used = pairs.select(F.col("u").alias("one")).union(pairs.select("v")).distinct()
    wanted = work.cut(used.join(distinct, F.col("one") == F.col("sig")).select("one", "least"), "wanted")
    texts = docs.join(wanted.select("least").distinct(), F.col("doc_id") == F.col("least")).select("doc_id", "text")
    sets = work.cut(_sets(texts).dropDuplicates(["of"]), "sets")
    left, right = sets.toDF("x", "xs"), sets.toDF("y", "ys")
    # Joined in two steps of plain scans, so that Spark can split a pair side with one hot set.
    half = work.cut(pairs.join(left, F.col("u") == F.col("x")).select("u", "v", "xs"), "half")
    both = half.join(right, F.col("v") == F.col("y")).withColumn("met", F.size(F.array_intersect("xs", "ys")))
    return both.where(F.col("met") >= SIMILAR * (F.size("xs") + F.size("ys") - F.col("met")) - 1e-9).select("u", "v")


def _close(a: str, b: str):
    return F.least(a, b) >= SIMILAR * F.greatest(a, b) - 1e-9


def _by_prefix(sets: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``sets`` (sig, n, root) of different roots that may be similar.

    Shingles are put in order of the number of ``sets`` that have them. Similar
    sets have 80 % of the larger one's shingles in common, so among the first
    n - 0.8 n + 1 shingles of each there is a common one."""
    wanted = sets.select(F.col("sig").alias("one")).join(distinct.select("sig", "least"), F.col("one") == F.col("sig")).select("least")
    texts = docs.join(work.cut(wanted, "wanted"), F.col("doc_id") == F.col("least")).select("doc_id", "text")
    held = work.cut(_sets(texts).dropDuplicates(["of"]).select("of", F.explode("held").alias("shingle")), "shingles")
    often = work.cut(held.groupBy(F.col("shingle").alias("same")).agg(F.count("*").alias("often")), "often")
    counted = work.cut(held.join(often, F.col("shingle") == F.col("same")).select("of", "shingle", "often"), "counted")
    order = F.row_number().over(Window.partitionBy("of").orderBy("often", "shingle"))
    ranked = counted.withColumn("rank", order).join(sets, F.col("of") == F.col("sig"))
    prefix = ranked.where((F.col("rank") <= F.col("n") - F.ceil(SIMILAR * F.col("n") - 1e-9) + 1) & (F.col("often") > 1)).select("sig", "n", "root", "shingle")
    prefix = work.cut(prefix, "prefix")
    other = prefix.toDF("u", "un", "its", "same")
    return prefix.join(other, (F.col("shingle") == F.col("same")) & (F.col("sig") < F.col("u")) & (F.col("root") != F.col("its")) & _close("n", "un")).select("u", F.col("sig").alias("v"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by similar sets.

    Rows with a null doc_id take no part; texts without words are equal sets.
    Repeated rows give a row each. Only doc_id and text are read."""
    docs = work.bound_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")
    rows = work.cut(_described(docs), "described")
    distinct = work.cut(rows.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("print").alias("print"), F.min("bands").alias("bands"), F.min("planes").alias("planes")), "distinct")
    keys = work.cut(distinct.select("sig", "n", F.explode("bands").alias("key")), "keys")
    sizes = work.cut(keys.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("held"), F.min("sig").alias("lead")).where("held > 1"), "sizes")
    shared = work.cut(keys.join(sizes, F.col("key") == F.col("bucket")).select("sig", "n", "key", "held", "lead"), "shared")
    led = shared.select(F.col("lead").alias("u"), F.col("sig").alias("v"))
    reps = work.cut(distinct.groupBy(F.col("print").alias("p")).agg(F.min("sig").alias("rep")), "reps")
    alike = distinct.join(reps, F.col("print") == F.col("p")).select(F.col("rep").alias("u"), F.col("sig").alias("v"))
    links = work.cut(_verified(led.union(alike), docs, distinct), "links")
    roots = work.cut(components(links), "roots")
    marked = work.cut(shared.select("sig", "n", "key").join(roots, F.col("sig") == F.col("node"), "left").select("sig", "n", "key", F.coalesce("root", "sig").alias("root")), "marked")
    counts = marked.groupBy("key", "root").agg(F.count("*").alias("many"))
    top = work.cut(counts.groupBy(F.col("key").alias("bucket")).agg(F.max_by("root", "many").alias("top"), F.count("*").alias("roots")).where("roots > 1"), "top")
    mixed = work.cut(marked.join(top, F.col("key") == F.col("bucket")).select(F.col("sig").alias("one"), "key", "root", "top"), "mixed")
    mixed = work.cut(mixed.join(distinct.select("sig", "n", "planes", "bands"), F.col("one") == F.col("sig")).select("sig", "n", "planes", "bands", "key", "root", "top"), "mixed")
    rest = work.cut(mixed.where("root <> top").select(F.col("sig").alias("u"), F.col("n").alias("un"), F.col("planes").alias("its_planes"), F.col("bands").alias("its_bands"), F.col("key").alias("other"), F.col("root").alias("its")), "rest")
    words = [F.col("planes")[k].bitwiseXOR(F.col("its_planes")[k]) for k in range(4)]
    apart = F.bit_count(words[0].bitwiseOR(words[1]).bitwiseOR(words[2]).bitwiseOR(words[3]))
    first_met = F.array_position(F.zip_with("bands", "its_bands", lambda x, y: x == y), True) == F.array_position("bands", F.col("key"))
    across = mixed.join(rest, (F.col("key") == F.col("other")) & (F.col("root") != F.col("its")) & _close("n", "un") & (apart <= NEAR) & first_met).select("u", F.col("sig").alias("v"))
    links = work.cut(links.union(_verified(across, docs, distinct)), "links")
    roots = work.cut(components(links), "roots")
    left = mixed.select("sig", "n").distinct().join(roots, F.col("sig") == F.col("node"), "left").select("sig", "n", F.coalesce("root", "sig").alias("root"))
    rare = _by_prefix(work.cut(left, "left"), docs, distinct)
    bits = work.cut(simhash_golay.links(reps.select(F.col("p").alias("print"))), "bits").toDF("a", "b")
    golay = bits.join(reps.toDF("p", "u"), F.col("a") == F.col("p")).select("u", "b").join(reps.toDF("q", "v"), F.col("b") == F.col("q")).select("u", "v")
    golay = golay.join(roots.toDF("x", "xr"), F.col("u") == F.col("x"), "left").join(roots.toDF("y", "yr"), F.col("v") == F.col("y"), "left")
    golay = golay.where(F.coalesce("xr", "u") != F.coalesce("yr", "v")).select("u", "v")
    more = work.cut(_verified(rare.union(golay), docs, distinct), "more")
    roots = components(links.union(more))
    rooted = work.cut(distinct.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("root", "sig").alias("root")), "rooted")
    ids = rooted.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    named = work.cut(rooted.join(ids, F.col("root") == F.col("top")).select(F.col("sig").alias("named"), "component_id"), "named")
    return rows.select("doc_id", "sig").join(named, F.col("sig") == F.col("named")).select("doc_id", "component_id")
