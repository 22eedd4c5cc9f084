"""Best-fit packing of tokenized documents into fixed-length sequences.

The packing is bulk-synchronous best-fit (``plan``). Documents and gaps are
range-sorted by length, a task for each range sweeps the documents to their
successor gaps, conflicts are resolved by rank, gaps are updated, and the
superstep is repeated, from the longest class of lengths to the shortest.
Lengths and gaps are whole numbers up to the capacity, so the sorted lists are
held run-length encoded: a length with its number of pieces, a gap with its
interval of bins. Ranks and places of single pieces are computed by Spark,
salted so that no length sits in one task.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultspark.llm import arrow, work

CAPACITY = 2048
SEPARATOR = 0
CACHED_CHUNKS = 1_000_000
MARK = "|"
RANGES = 4
STEP = 1.5
ROWS_PER_SALT = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCache:
    """Ids of texts, by looking up chunks.

    The tokenizer's pre-tokens never cross white space, so the ids of a text
    are those of its chunks between spaces and line ends, and chunks already
    met are looked up: Arrow cuts a batch of texts and numbers its different
    chunks, Python sees each of these once. The tokenizer lower-cases; where
    lower-casing the whole text and cutting a full stop or comma off the end of
    a chunk cannot change the pre-tokens, that is done first, as it leaves
    fewer chunks. New chunks are tokenized together: those of Latin letters are
    words, whose ids end at the tokens that end a word, others stand between
    marks. When the table is full, chunks met in one batch only are forgotten."""

    def __init__(self, path: str, most: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        size = self.tokenizer.get_vocab_size()
        self.ends = np.asarray([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.plain = re.compile("[a-zà-öø-ÿ]+").fullmatch
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.keep([], np.empty(0, np.int64))

    @classmethod
    def of_worker(cls, path: str) -> WordCache:
        """The cache of this Python worker, which serves many tasks."""
        kept = vars(sys).setdefault("_faultspark_word_caches", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def keep(self, chunks: list[str], rows: np.ndarray) -> None:
        """Start the table anew with some of its chunks."""
        sizes = self.sizes[rows] if len(rows) else np.empty(0, np.int32)
        ids = arrow.gather(self.flat, self.begins[rows], sizes) if len(rows) else np.empty(0, np.uint32)
        self.known = dict(zip(chunks, range(len(chunks))))
        self.count, self.filled = len(chunks), len(ids)
        self.flat = np.empty(2 * self.filled + (1 << 16), np.uint32)
        self.flat[: self.filled] = ids
        room = 2 * self.count + (1 << 14)
        self.begins, self.sizes, self.used = np.zeros(room, np.int64), np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.begins[: self.count], self.sizes[: self.count] = np.cumsum(sizes) - sizes, sizes

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(chunks) > len(self.sizes):
            self.begins, self.sizes, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes, self.used))
        self.flat[self.filled : self.filled + len(ids)] = ids
        rows = slice(self.count, self.count + len(chunks))
        self.begins[rows], self.sizes[rows] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.known.update(zip(chunks, range(rows.start, rows.stop)))
        self.filled, self.count = self.filled + len(ids), rows.stop

    def spaced(self, texts: pa.Array) -> pa.Array:
        """Texts whose chunks stand between spaces."""
        flat = pc.replace_substring(texts, "\n", " ")
        ended = pc.binary_join_element_wise(flat, *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
        simple = pc.invert(pc.or_(pc.match_substring_regex(ended, r"[^\x{0}-\x{FF}]"), pc.match_substring_regex(ended, r"[^\p{L}\p{N} ][.,] ")))
        cut = pc.utf8_lower(ended)
        for stop in ".,":
            cut = pc.replace_substring(cut, stop + " ", f" {stop} ")
        return pc.if_else(simple, cut, flat)

    def each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.asarray([i for x in ids for i in x], np.uint32), np.asarray([len(x) for x in ids], np.int32)

    def joined(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.joined(" ".join(chunks))
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(chunks) else self.each(chunks)

    def marked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.joined(f" {MARK} ".join(chunks))
        at = np.flatnonzero(ids == self.mark)
        return (np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1) if len(at) == len(chunks) - 1 else self.each(chunks)

    def learn(self, chunks: list[str]) -> None:
        plain, groups = self.plain, ([], [], [])
        for c in chunks:
            groups[0 if plain(c) else 2 if self.mark is None or MARK in c else 1].append(c)
        for group, encode in zip(groups, (self.words, self.marked, self.each)):
            for at in range(0, len(group), 1024):
                part = group[at : at + 1024]
                self.add(part, *encode(part))

    def places(self, chunks: list[str]) -> np.ndarray:
        """The rows of chunks in the table."""
        place = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        fresh = np.flatnonzero(place < 0).tolist()
        if fresh:
            new = [chunks[k] for k in fresh]
            self.learn(new)
            place[fresh] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.used[place] += 1
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        if self.count > self.most:
            rows = np.flatnonzero(self.used[: self.count] > 1)[: self.most // 2]
            old = list(self.known)
            self.keep([old[k] for k in rows.tolist()], rows)
        parts = pc.split_pattern(self.spaced(texts.cast(pa.large_string())), " ")
        coded = pc.list_flatten(parts).dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.sizes[place]
        ids = arrow.gather(self.flat, self.begins[place], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        cuts = parts.offsets.to_numpy()
        return ids, ends[cuts[1:] - cuts[0]]


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document's ids and the separator.

    A null or empty text gives the separator alone. Rows keep their doc_id as
    it is, null and repeated ones included. With ``keep_ids`` the column ids
    has the piece's ids as little-endian unsigned 32-bit bytes."""
    path = path or default_tokenizer()
    schema = PIECES + (", ids binary" if keep_ids else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]

    def pieces(docs: list, data: memoryview, ends: list[int]) -> pa.RecordBatch:
        out, begin, step = [], 0, 4 * capacity
        for doc, end in zip(docs, ends):
            for k, at in enumerate(range(begin, end, step)):
                ids = data[at : min(at + step, end)]
                out.append((doc, k, k * capacity, len(ids) // 4, zlib.crc32(ids), *([bytes(ids)] if keep_ids else [])))
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.tidy("_faultspark_word_caches")
        cache = WordCache.of_worker(path)
        for batch in batches:
            if batch.num_rows:
                ids, ends = cache.encode(pc.fill_null(batch.column(1), ""))
                data = np.insert(ids, ends, SEPARATOR).astype("<u4", copy=False)
                yield pieces(batch.column(0).to_pylist(), memoryview(data).cast("B"), (4 * (ends + np.arange(1, len(ends) + 1))).tolist())
        arrow.tidy("_faultspark_word_caches")

    return work.bound_batches(docs).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int = CAPACITY) -> tuple[list, list, list, list]:
    """Match runs of documents to their successor gaps, longest first.

    Documents are runs (length, first rank, how many), gaps runs (gap, first
    bin, how many). A length takes the least gap that holds it and that no longer
    one has taken; the piece of rank r takes the r-th place of the run's bins.
    Returns the matches (length, first rank, end rank, first bin, pieces a bin,
    tokens already in the bin), documents and gaps that are left, and the gaps
    that matched bins have now."""
    docs, gaps = sorted(docs, reverse=True), sorted(gaps, reverse=True)
    open_, matches, left, after, met = [], [], [], [], 0
    for length, rank, many in docs:
        while met < len(gaps) and gaps[met][0] >= length:
            open_.append(gaps[met])
            met += 1
        while many and open_:
            gap, first, bins = open_.pop()
            each = gap // length
            used = min(bins, -(-many // each))
            placed = min(many, used * each)
            matches.append((length, rank, rank + placed, first, each, capacity - gap))
            full, rest = divmod(placed, each)
            if full and gap > each * length:
                after.append((gap - each * length, first, full))
            if rest:
                after.append((gap - rest * length, first + full, 1))
            if bins > used:
                open_.append((gap, first + used, bins - used))
            rank, many = rank + placed, many - placed
        if many:
            left.append((length, rank, many))
    return matches, left, open_ + gaps[met:], after


GAP, DOC, NEW, MATCH = range(4)
STATE = "kind int, value bigint, first bigint, many bigint, end bigint, bin bigint, each bigint, used bigint"


def _swept(state: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Each partition's rows of STATE after a sweep; new gaps wait for the ``last`` one to end."""
    names = [c.split()[0] for c in STATE.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: tuple = ([], [], [], [])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs[row[0]].append(row[1:])
        matches, docs, gaps, after = sweep([r[:3] for r in runs[DOC]], [r[:3] for r in runs[GAP]], capacity)
        rows = [(GAP, *r) for r in gaps] + [(DOC, *r) for r in docs] + [(GAP if last else NEW, *r) for r in after + [r[:3] for r in runs[NEW]]]
        out = [(*r, None, None, None, None) for r in rows] + [(MATCH, *r) for r in runs[MATCH]]
        out += [(MATCH, length, r0, None, r1, first, each, used) for length, r0, r1, first, each, used in matches]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return state.mapInArrow(run, STATE)


def classes(capacity: int) -> list[tuple[int, int]]:
    """Ranges (above, up to) of lengths that are placed together, longest first."""
    ends = [capacity, capacity // 2]
    while ends[-1]:
        ends.append(min(ends[-1] - 1, int(ends[-1] / STEP)) if ends[-1] > 4 else 0)
    return list(zip(ends[1:], ends))


def plan(lengths: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """Places of all ranks of each length, from ``lengths`` (length, many).

    Supersteps: the documents of a class of lengths and the gaps of all bins are
    range-sorted; each range is swept by a task of its own; documents whose
    range had no gap left meet the gaps that other ranges left, and ranks settle
    which of them gets which; bins have their new gaps, and the step is repeated
    with what is unplaced. As many bins as the tokens need at least are there
    from the start; more are opened when no gap holds a document. Each
    step's state is written to the shared folder. It is run-length encoded: its
    rows are bounded by the capacity and not by the documents."""
    spark = lengths.sparkSession
    blank = [F.lit(None).cast("bigint").alias(c) for c in ("end", "bin", "each", "used")]
    docs = lengths.select(F.lit(DOC).alias("kind"), F.col("length").alias("value"), F.lit(0).cast("bigint").alias("first"), "many", *blank)
    parts = classes(capacity)
    of = F.coalesce(*(F.when(F.col("length") > low, k) for k, (low, _) in enumerate(parts)))
    held = {r[0]: r[1:] for r in lengths.groupBy(of.alias("class")).agg(F.sum("many"), F.sum(F.col("many") * F.col("length"))).collect()}
    opened = max(-(-sum(r[1] for r in held.values()) // capacity), held.get(0, (0,))[0])
    new_bins = lambda first, many: spark.createDataFrame([(GAP, capacity, first, many, None, None, None, None)], STATE)
    state, done = new_bins(0, opened), []
    for k, (low, high) in enumerate(parts):
        if k not in held:
            continue
        todo = docs.where((F.col("value") > low) & (F.col("value") <= high))
        while True:
            ranged = state.unionByName(todo).repartitionByRange(ranges, "value")
            path = work.new_path(spark, "step")
            _swept(_swept(ranged, capacity, False).repartition(1), capacity, True).write.parquet(path)
            done.append(path)
            state = spark.read.schema(STATE).parquet(path)
            todo, state = state.where(F.col("kind") == DOC), state.where(F.col("kind") == GAP)
            left = todo.agg(F.min("value"), F.sum(F.col("value") * F.col("many"))).first()
            if left[0] is None:
                break
            if (state.agg(F.max("value")).first()[0] or 0) < left[0]:
                more = -(-left[1] // capacity)
                state, opened = state.unionByName(new_bins(opened, more)), opened + more
    matches = spark.read.schema(STATE).parquet(*done) if done else spark.createDataFrame([], STATE)
    return matches.where(F.col("kind") == MATCH).select(F.col("value").alias("_at"), F.col("first").alias("_r0"), F.col("end").alias("_r1"), F.col("bin").alias("_first"), F.col("each").alias("_each"), F.col("used").alias("_used"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    Pieces of equal length are interchangeable; which of them gets which place
    is settled by a salted rank. An empty table stays empty."""
    total = pieces.count()
    salts = max(8, -(-total // ROWS_PER_SALT))
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(salts)).cast("int"))
    cells = work.cut(keyed.groupBy(F.col("length").alias("_length"), F.col("_salt").alias("_cell")).agg(F.count("*").alias("_n")), "cells")
    lengths = work.cut(cells.groupBy(F.col("_length").alias("length")).agg(F.sum("_n").alias("many")), "lengths")
    before = Window.partitionBy("_length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_cell"))).withColumn("_rank", F.col("_row") + F.col("_before"))
    rank = F.col("_rank") - F.col("_r0")
    placed = ranked.join(F.broadcast(plan(lengths, capacity)), (F.col("length") == F.col("_at")) & (F.col("_rank") >= F.col("_r0")) & (F.col("_rank") < F.col("_r1")))
    return placed.select(
        *pieces.columns,
        (F.col("_first") + F.floor(rank / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_used") + rank % F.col("_each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize whole documents and pack their pieces; one row per piece.

    Null text is empty; an empty document is its separator alone; repeated
    rows are packed each; an empty table gives no rows. Other columns of
    ``docs`` are not read."""
    return pack(work.cut(tokenize(docs, path, capacity, keep_ids), "pieces"), capacity)


def op9_bestfit(spark, sf_dir: str) -> DataFrame:
    return pack_documents(work.read(spark, sf_dir, "documents"))
