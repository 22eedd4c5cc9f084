"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

Merge-type (BPE) segmentation with an agenda: candidate merges leave a heap by
score, leftmost first. A keyed hash of seed, document, the chunk's place in it
and the candidate's number decides whether it is skipped, so a seed gives the same
varied segmentation anywhere. With a rate of 0 the ids are those of the
sentencepiece library.

No piece of the vocabulary reaches across the start of a run of spaces or a
line end, so texts are cut there. What a chunk becomes depends only on which of
its candidates are skipped. These histories are a tree: a node has the ids of a
chunk after some skips and none later, and a child for each later candidate. Each
occurrence draws its own bits and walks from the root by its next skip until it
has none left; all occurrences of a batch walk together, and nodes that are
missing are segmented together.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm import arrow, work

RATE = 0.1
SEED = 17
NODES = 1_400_000  # a worker's tree starts anew beyond them
SPACE = "▁"
WALKED = 1 << 20
MIX, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
LANES = 4  # candidates decided by one hash, by 16 bits each
LONGEST = 21  # characters of the chunks in the tree: they have at most 60 candidates
NEVER = (1 << 31) - 1
STEP_ROWS = 6_000
FIRST = 0x250


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A BPE sentencepiece model's vocabulary, with dropout encoding and decoding."""

    def __init__(self, path: str, rate: float = RATE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bar = round(rate * 2**16)
        self.ranks: dict[str, tuple[float, int]] = {}
        self.raw: list[bytes] = []
        self.bytes_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes_id[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.ranks[piece.replace(SPACE, " ")] = (-model.get_score(i), i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        if any(re.search(r"[^ ] |.\n|\n.", p) for p in self.ranks):
            raise ValueError("a piece reaches across spaces or line ends")
        self._tables()
        self.raw_sizes = np.array([len(r) for r in self.raw], np.int32)
        self.raw_begins = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        if any(re.search(r"[^\W_][.,]", p) for p in self.ranks):
            self.chunks = re.compile(r" *[^ \n]+| +|\n").findall
        else:  # no piece joins a letter or digit and a mark behind it, so chunks end there too
            self.chunks = re.compile(r" *(?:[^ \n.,]+|(?<![^\W_])[.,])+|[.,](?:[^ \n.,]+|(?<![^\W_])[.,])*| +|\n").findall
        self._clear()

    @classmethod
    def of_worker(cls, path: str, rate: float) -> Pieces:
        """The vocabulary and cache of this Python worker, which serves many tasks."""
        kept = vars(sys).setdefault("_faultspark_pieces", {})
        if (path, rate) not in kept:
            kept.clear()
            kept[path, rate] = cls(path, rate)
        return kept[path, rate]

    def segment(self, chunk: str, key: int) -> list[int]:
        """Ids of a chunk, in which a space stands for the vocabulary's space mark.

        Candidate number k is skipped if 16 bits of a hash of the key and k are low."""
        ranks, bar = self.ranks, self.bar
        # A space mark in the text itself is no space: it never merges.
        parts: list[str | None] = list(chunk.replace(SPACE, "\0"))
        n = len(parts)
        before, after, ends = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        founds = map(ranks.get, map(str.__add__, parts, parts[1:]))
        agenda = [(found[0], left, left + 1, left + 2) for left, found in enumerate(founds) if found]
        heapq.heapify(agenda)
        number = -1
        while agenda:
            _, left, right, end = heapq.heappop(agenda)
            if parts[left] is None or after[left] != right or right >= n or parts[right] is None or ends[right] != end:
                continue
            number += 1
            if bar:
                if number % LANES == 0:
                    drawn = mixed(key + (number // LANES + 1) * MIX)
                if drawn >> 16 * (number % LANES) & 0xFFFF < bar:
                    continue
            parts[left] += parts[right]
            parts[right] = None
            ends[left], after[left] = end, after[right]
            if after[left] < n:
                before[after[left]] = left
                if found := ranks.get(parts[left] + parts[after[left]]):
                    heapq.heappush(agenda, (found[0], left, after[left], ends[after[left]]))
            if before[left] >= 0:
                at = before[left]
                if found := ranks.get(parts[at] + parts[left]):
                    heapq.heappush(agenda, (found[0], at, left, end))
        ids: list[int] = []
        at = 0
        while at < n:
            if found := ranks.get(parts[at]):
                ids.append(found[1])
            else:
                ids.extend(self.bytes_id[b] for b in chunk[at : ends[at]].encode())
            at = after[at]
        return ids

    def _tables(self) -> None:
        """The characters' symbols, and for each pair of symbols what it merges to."""
        ids = {p: i for p, (_, i) in self.ranks.items()}
        ordered = {score: k for k, score in enumerate(sorted({r[0] for r in self.ranks.values()}))}
        self.symbols = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.symbols[ord(SPACE)] = -1
        self.count = len(self.raw)
        found = [(ids[p[:k]] * self.count + ids[p[k:]], ordered[score], i) for p, (score, i) in self.ranks.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        found.sort()
        keys, ranks, merged = zip(*found) if found else ((), (), ())
        # A table of the pairs of the first characters, as all agendas start with pairs of characters.
        small = [i for i in self.symbols[:FIRST] if i >= 0]
        self.small = np.full(self.count + 1, -1, np.int32)
        self.small[small] = np.arange(len(small))
        self.small_rank = np.full((len(small), len(small)), NEVER, np.int32)
        self.small_id = np.zeros_like(self.small_rank)
        for pair, rank, i in found:
            a, b = self.small[pair // self.count], self.small[pair % self.count]
            if a >= 0 and b >= 0:
                self.small_rank[a, b], self.small_id[a, b] = rank, i
        self.pairs, self.pair_ranks, self.pair_ids = np.array(keys, np.int64), np.array(ranks, np.int32), np.array(merged, np.int32)

    def _candidates(self, left: np.ndarray, right: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging symbols; NEVER where there is no piece."""
        if first:
            a, b = self.small[left], self.small[right]
            rank, result = self.small_rank[a, b], self.small_id[a, b]
            ok = (a >= 0) & (b >= 0)
        else:
            pair = left.astype(np.int64) * self.count + right
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank, result = self.pair_ranks[at], self.pair_ids[at]
            ok = (self.pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(ok, rank, NEVER), result

    def segment_many(self, chunks: list[str], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks of known characters, one chunk's behind the other's, their
        numbers, and how many candidates each chunk had, if those that the bits of its
        mask name are skipped. All agendas are worked off in step."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.symbols[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        begins = np.cumsum(sizes) - sizes
        counts, popped, parts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), []
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 11), (11, 15), (15, LONGEST)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(rows), STEP_ROWS):
                part = rows[at : at + STEP_ROWS]
                parts.append((part, *self._in_step(high, symbols, begins[part], sizes[part], masks[part])))
                counts[part], popped[part] = parts[-1][2:]
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, symbol, many, _ in parts:
            inside = np.arange(symbol.shape[1]) < many[:, None]
            ids[((ends - counts)[rows][:, None] + np.arange(symbol.shape[1]))[inside]] = symbol[inside]
        return ids, counts, popped

    def _in_step(self, width, symbols, begins, sizes, masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of symbols for each chunk, how many count, and its number of candidates."""
        columns = np.arange(width)
        inside = columns < sizes[:, None]
        symbol = np.full((len(sizes), width + 1), -1, np.int32)
        symbol[:, :width][inside] = symbols[(begins[:, None] + columns)[inside]]
        rank, result = self._candidates(symbol[:, :width], symbol[:, 1:], first=bool((self.small[symbol[:, :width][inside]] >= 0).all()))
        done, left, popped = np.empty((len(sizes), width), np.int32), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        rows, count, number = np.arange(len(sizes)), sizes.copy(), 0
        while len(rows):
            each = np.arange(len(rows))
            best = rank.argmin(1)
            live = rank[each, best] < NEVER
            if not live.all():
                over = ~live
                done[rows[over]], left[rows[over]], popped[rows[over]] = symbol[over, :width], count[over], number
                rows, best, symbol, rank, result, count, masks = (x[live] for x in (rows, best, symbol, rank, result, count, masks))
                each = np.arange(len(rows))
                if not len(rows):
                    break
            skipped = (masks >> np.uint64(number) & np.uint64(1)).astype(bool)
            number += 1
            if skipped.any():
                rank[each[skipped], best[skipped]] = NEVER
            merged = result[each, best]
            after = columns >= np.where(skipped, width, best + 1)[:, None]
            symbol[:, :-1] = np.where(after, symbol[:, 1:], symbol[:, :-1])
            after = after[:, : width - 1]
            rank[:, :-1], result[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1]), np.where(after, result[:, 1:], result[:, :-1])
            going = np.flatnonzero(~skipped)
            best = best[going]
            symbol[going, best] = merged[going]
            count[going] -= 1
            for place in (best, best - 1):
                ok = place >= 0
                row, p = going[ok], place[ok]
                rank[row, p], result[row, p] = self._candidates(symbol[row, p], symbol[row, p + 1])
        return done, left, popped

    def _clear(self) -> None:
        """An empty tree. Node k has ids[begin : begin + size], the window of candidates
        that its next skip may be, and a slot for each of them in ``child``."""
        self.roots: dict[str, int] = {}
        self.texts: list[str] = []
        self.nodes = self.slots = self.filled = 0
        self.ids, self.child = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.of = {name: np.empty(1 << 14, kind) for name, kind in (("text", np.int32), ("mask", np.uint64), ("window", np.uint64), ("first", np.int64), ("slot", np.int64), ("begin", np.int64), ("size", np.int64))}

    def _grow(self, texts: np.ndarray, masks: np.ndarray, firsts: np.ndarray, ids: np.ndarray, counts: np.ndarray, popped: np.ndarray) -> np.ndarray:
        """New nodes, whose next skip may be any candidate from ``firsts`` up to ``popped``."""
        many = len(counts)
        while self.nodes + many > len(self.of["text"]):
            self.of = {k: np.concatenate([x, np.empty_like(x)]) for k, x in self.of.items()}
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        width = np.maximum(popped - firsts, 0)
        total = int(width.sum())
        while self.slots + total > len(self.child):
            self.child = np.concatenate([self.child, np.empty_like(self.child)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.child[self.slots : self.slots + total] = -1
        one, at = np.uint64(1), slice(self.nodes, self.nodes + many)
        upto = (one << popped.astype(np.uint64)) - one
        window = upto & ~((one << firsts.astype(np.uint64)) - one)
        values = (texts, masks, window, firsts, self.slots + np.cumsum(width) - width, self.filled + np.cumsum(counts) - counts, counts)
        for (name, x), value in zip(self.of.items(), values):
            x[at] = value
        self.nodes, self.slots, self.filled = at.stop, self.slots + total, self.filled + len(ids)
        return np.arange(at.start, at.stop)

    def _plant(self, chunks: list[str]) -> None:
        """Root nodes of new chunks; -1 for those that aren't kept in the tree."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.symbols[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        fits = (sizes <= LONGEST) & (np.minimum.reduceat(symbols, np.cumsum(sizes) - sizes) >= 0)
        kept = [chunks[k] for k in np.flatnonzero(fits).tolist()]
        none = np.zeros(len(kept), np.int64)
        made = self._grow(len(self.texts) + np.arange(len(kept)), none, none, *self.segment_many(kept, none.astype(np.uint64)))
        self.texts += kept
        self.roots.update(zip(chunks, [-1] * len(chunks)))
        self.roots.update(zip(kept, made.tolist()))

    def _draw(self, keys: np.ndarray, many: np.ndarray) -> np.ndarray:
        """For each key the bits of its first candidates, of which there are ``many``."""
        bits = np.zeros(len(keys), np.uint64)
        for word in range(-(-int(many.max(initial=0)) // LANES)):
            some = np.flatnonzero(many > LANES * word)
            drawn = mixed_all(keys[some] + np.uint64((word + 1) * MIX & MASK))
            low = np.packbits(drawn.astype("<u8", copy=False).view("<u2").reshape(-1, LANES) < self.bar, axis=1, bitorder="little")[:, 0]
            bits[some] |= low.astype(np.uint64) << np.uint64(LANES * word)
        return bits

    def _walk(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks with their keys, one behind the other, and their numbers."""
        coded = pa.array(chunks, pa.large_string()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        if fresh := [c for c in different if c not in self.roots]:
            self._plant(fresh)
        code = coded.indices.to_numpy()
        node = np.fromiter(map(self.roots.__getitem__, different), np.int64, len(different))[code]
        if self.bar:
            long = np.fromiter(map(len, different), np.int64, len(different))[code]
            bits = self._draw(keys, np.where(node >= 0, 3 * (long - 1), 0))
            active = np.flatnonzero(node >= 0)
            while True:
                here = node[active]
                later = bits[active] & self.of["window"][here]
                moving = later != 0
                active, here, later = active[moving], here[moving], later[moving]
                if not len(active):
                    break
                skip = np.bitwise_count((later & (~later + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                slot = self.of["slot"][here] + skip - self.of["first"][here]
                to = self.child[slot]
                if len(missing := np.flatnonzero(to < 0)):
                    new, which = np.unique(slot[missing], return_index=True)
                    parent, skips = here[missing[which]], skip[missing[which]]
                    texts = self.of["text"][parent]
                    masks = self.of["mask"][parent] | np.uint64(1) << skips.astype(np.uint64)
                    self.child[new] = self._grow(texts, masks, skips + 1, *self.segment_many([self.texts[k] for k in texts.tolist()], masks))
                    to = self.child[slot]
                node[active] = to
        if len(rest := np.flatnonzero(node < 0)):  # long chunks, and characters that are no pieces
            found = [self.segment(chunks[k], int(keys[k])) for k in rest.tolist()]
            none = np.zeros(len(rest), np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            node[rest] = self._grow(none - 1, none, none, ids, np.fromiter(map(len, found), np.int64, len(found)), none)
        counts = self.of["size"][node]
        return arrow.gather(self.ids, self.of["begin"][node], counts), counts

    def encode_all(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one behind the other, and where each text's end; an empty text has none."""
        cut = [self.chunks(" " + t) if t else [] for t in texts]
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.cumsum(many)
        chunks = list(chain.from_iterable(cut))
        place = np.arange(len(chunks), dtype=np.uint64) - np.repeat((ends - many).astype(np.uint64), many)
        own = mixed_all(np.repeat(np.array(keys, np.uint64), many) ^ (place + np.uint64(1)) * np.uint64(MIX))
        ids, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for at in range(0, len(chunks), WALKED):
            if self.nodes > NODES:
                self._clear()
            for kept, got in zip((ids, counts), self._walk(chunks[at : at + WALKED], own[at : at + WALKED])):
                kept.append(got)
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))[ends]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of texts from their ids, all at once."""
        sizes = self.raw_sizes[ids]
        data = arrow.gather(self.raw_bytes, self.raw_begins[ids], sizes).tobytes()
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.concatenate([[0], ends])].tolist()
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(at, at[1:])]


def mixed(z: int) -> int:
    """The finalizer of splitmix64."""
    z &= MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


def mixed_all(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def doc_key(seed: int, doc_id) -> int:
    return xxhash.xxh64_intdigest(b"%d|" % seed + str(doc_id).encode())


def encode(docs: DataFrame, path: str | None = None, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, their number and checksum, and whether they decode to the text.

    Null and empty texts have no ids and count as lossless. A null doc_id is a
    key like any other; repeated rows give equal rows. Only the two named
    columns are read; texts are taken whole."""
    path = path or default_model()
    names = ["doc_id", "n_tokens", "ids_crc32", "lossless", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.tidy("_faultspark_pieces")
        pieces = Pieces.of_worker(path, rate)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends = pieces.encode_all(texts, [doc_key(seed, i) for i in batch.column(0).to_pylist()])
            at = np.concatenate([[0], ends])
            data = memoryview(ids.astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
            same = [b == t.encode() for b, t in zip(pieces.decode_all(ids, ends), texts)]
            columns = [batch.column(0), pa.array(np.diff(at)), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
            yield pa.RecordBatch.from_arrays(columns, names)
        arrow.tidy("_faultspark_pieces")

    return work.bound_batches(docs).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, lossless boolean, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of ids; null ids give an empty text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, 0.0)
        for batch in batches:
            texts = [pieces.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")


def op1_spm_dropout(spark, sf_dir: str) -> DataFrame:
    return encode(work.read(spark, sf_dir, "documents"))
