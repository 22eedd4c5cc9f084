"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line (spaces trimmed) that isn't blank is dropped if an equal line stands
earlier, by doc_id and line number, anywhere in the corpus, however short it
is. A line of at least ``NEAR_CHARS`` characters is dropped also if an earlier
line of as many is within ``THRESHOLD`` = 2 edits of it.

Near lines: a line has threshold-plus-one = 3 segments, whose lengths follow
from its length alone (a multiple of ``STEP`` below it): one at its start, one
behind that, one at its end. Two edits leave a segment whole; if it is neither
the first nor the last, the edits before and behind it are one each, so it has
moved by at most one place. So a line has five keys, the middle segment's at
three places, and five more under the length class below if it is within two
characters of it. Lines that share a key, and whose sketches of neighbouring
characters differ by no more than two edits can make them, are candidates. They
are verified by a banded bit-parallel edit distance: a bit for each of five
diagonals, a word for each number of edits.

Keys with more than ``LIMIT`` lines are split by counts of four classes of
characters: two edits change each count by at most two, so a line looks for its
partners in the cells of counts that are two away at most; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.llm import work

MIN_CHARS = 1
NEAR_CHARS = 12
THRESHOLD = 2
STEP = 12
LIMIT = 48
CELL = 6
CLASSES = ("eéEÉ", "tnTN", "aoáóAO", "rhlcRHLC")
BROADCAST_ROWS = 1_000_000
LAST = (1 << 63) - 1


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that take part: document, its text's hash, place, line and its hashes."""
    parted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc"),
        F.xxhash64("text").alias("body"),
        F.posexplode(F.split("text", "\n")).alias("at", "raw"),
    )
    found = parted.select("doc", "body", "at", F.trim("raw").alias("line")).where((F.char_length("line") >= MIN_CHARS) & F.col("line").rlike(r"\S"))
    place = F.coalesce("doc", F.lit(LAST)).cast("decimal(38,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("at")
    return found.select("doc", "body", "at", "line", place.cast("decimal(38,0)").alias("place"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(THRESHOLD), "line").alias("g"))


def _part(line: Column, at: Column, size: Column) -> Column:
    """A substring's bytes; where all characters are one byte, cut as bytes."""
    return F.when(F.octet_length(line) == F.char_length(line), F.substring(line.cast("binary"), at, size)).otherwise(F.substring(line, at, size).cast("binary"))


def _keys(line: Column, moves: bool = False) -> Column:
    """Array of the keys of a line's segments; with ``moves`` of (key, moved), where
    moved is 0 for a segment where it stands. None under ``NEAR_CHARS`` characters."""
    n = F.char_length(line)

    def of(base: Column) -> list[Column]:
        side = F.floor(base / 3).cast("int")
        middle = (base - 2 * side).cast("int")
        keys = [(1, _part(line, F.lit(1), side), 0), (3, _part(line, (n - side + 1).cast("int"), side), 0)]
        keys += [(2, _part(line, (side + 1 + m).cast("int"), middle), m) for m in (0, -1, 1)]
        hashed = [(F.xxhash64(F.lit(k), base, part), m) for k, part, m in keys]
        return [F.struct(h.alias("key"), F.lit(m).alias("moved")) if moves else h for h, m in hashed]

    base = (n - n % STEP).cast("int")
    own, below = F.array(*of(base)), F.array(*of((base - STEP).cast("int")))
    keys = F.when((n % STEP < THRESHOLD) & (base - STEP >= STEP), F.concat(own, below)).otherwise(own)
    return F.when(n >= NEAR_CHARS, keys).otherwise(F.slice(own, 1, 0))


def _sketch(line: Column) -> Column:
    """Two words of bits. A bit of ``two`` tells whether the neighbouring pairs of
    characters hashed to it are odd in number, one of ``one`` that of single
    characters. An edit takes away two pairs and a character and brings as many,
    at most, so two edits flip at most eight bits and four."""
    chars = F.split(line, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda x, y: F.hash(x, y))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)))
    odd = lambda hashes: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseXOR(bit(h)))
    return F.struct(odd(pairs).alias("two"), odd(F.transform(chars, lambda c: F.hash(c))).alias("one"))


def _counts(line: Column) -> list[Column]:
    return [F.char_length(line) - F.char_length(F.translate(line, c, "")) for c in CLASSES]


def within(a: Column, b: Column) -> Column:
    """Whether two arrays of one or more characters are within two edits, by
    bit-parallel steps over a band.

    After j characters of b, bit d + 2 of word e tells whether the first j + d
    characters of a become them by at most e edits. The words of a step sit in
    one integer, five bits each."""
    n, m = F.size(a), F.size(b)

    def step(w: Column, j: Column) -> Column:
        equal = [F.when(F.get(a, j + d - THRESHOLD).eqNullSafe(F.get(b, j)), F.lit(1 << d)).otherwise(F.lit(0)) for d in range(5)]
        eq = equal[0]
        for e in equal[1:]:
            eq = eq.bitwiseOR(e)
        return F.when(w == 0, w).otherwise(F.get(F.transform(F.array(eq), lambda q: advance(w, q)), F.lit(0)))

    def advance(w: Column, q: Column) -> Column:
        was = [F.shiftright(w, 5 * e).bitwiseAND(F.lit(31)) for e in range(3)]
        now = was[0].bitwiseAND(q)
        out = now
        for e in (1, 2):
            spent = was[e - 1].bitwiseOR(F.shiftright(was[e - 1], 1)).bitwiseOR(F.shiftleft(now, 1))
            now = was[e].bitwiseAND(q).bitwiseOR(spent).bitwiseAND(F.lit(31))
            out = out.bitwiseOR(F.shiftleft(now, 5 * e))
        return out

    start = F.lit(4 | 12 << 5 | 28 << 10)
    last = F.aggregate(F.sequence(F.lit(0), m - 1), start, step)
    place = F.least(F.lit(4), F.greatest(F.lit(0), n - m + THRESHOLD)) + 5 * THRESHOLD
    return (F.abs(n - m) <= THRESHOLD) & (F.call_function("shiftright", last, place).bitwiseAND(F.lit(1)) == 1)


def _pairs(few: DataFrame, limit: int) -> DataFrame:
    """Verified pairs (a, b) of line numbers of ``few`` (id, line, chars, sketch), a < b."""
    keyed = few.select("id", "sketch", F.char_length("line").alias("n"), F.explode(F.array_distinct(_keys(F.col("line"), True))).alias("k")).select("id", "n", "sketch", "k.key", "k.moved")
    keyed = work.cut(keyed, "keyed")
    sizes = work.cut(keyed.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("held")).where("held > 1"), "sizes")
    shared = work.cut(keyed.join(sizes, F.col("key") == F.col("bucket")).select("id", "n", "sketch", "key", "moved", "held"), "shared")
    light = shared.where(F.col("held") <= limit).select("id", "n", "sketch", "key", "moved")
    crowd = shared.where(F.col("held") > limit)
    crowded = work.cut(crowd.select(F.col("id").alias("one")).distinct(), "crowded")
    counted = few.join(crowded, F.col("id") == F.col("one")).select("one", *(c.alias(f"c{k}") for k, c in enumerate(_counts(F.col("line")))))
    cells = crowd.join(work.cut(counted, "counted"), F.col("id") == F.col("one"))
    for k in range(len(CLASSES)):
        low, high = (F.floor((F.col(f"c{k}") + d) / CELL).cast("int") for d in (-THRESHOLD, THRESHOLD))
        cells = cells.withColumn(f"p{k}", F.when(low < high, F.array(low, high)).otherwise(F.array(low)))
    home = cells.select("id", "n", "sketch", F.xxhash64("key", *(F.floor(F.col(f"c{k}") / CELL).cast("int") for k in range(len(CLASSES)))).alias("key"), "moved")
    for k in range(len(CLASSES)):
        cells = cells.withColumn(f"p{k}", F.explode(f"p{k}"))
    seek = cells.select("id", "n", "sketch", F.xxhash64("key", *(f"p{k}" for k in range(len(CLASSES)))).alias("key"), "moved")
    a, b = (work.cut(light.union(x), name).select(F.col("id").alias(s), F.col("n").alias(s + "n"), F.col("sketch").alias(s + "f"), F.col("key").alias(k), F.col("moved").alias(s + "m")) for x, name, s, k in ((home, "home", "a", "key"), (seek, "seek", "b", "other")))
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("an") - F.col("bn")) <= THRESHOLD) & ((F.col("am") == 0) | (F.col("bm") == 0)) & (F.bit_count(F.col("af.two").bitwiseXOR(F.col("bf.two"))) <= 4 * THRESHOLD) & (F.bit_count(F.col("af.one").bitwiseXOR(F.col("bf.one"))) <= 2 * THRESHOLD)
    pairs = a.join(b, (F.col("key") == F.col("other")) & near).select("a", "b").distinct()
    left = few.select(F.col("id").alias("x"), F.col("chars").alias("a_chars"))
    right = few.select(F.col("id").alias("y"), F.col("chars").alias("b_chars"))
    both = work.cut(pairs, "pairs").join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
    return both.where(within(F.col("a_chars"), F.col("b_chars"))).select("a", "b")


def decisions(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per line that has an equal or near line elsewhere: doc, body, at,
    whether it is dropped as equal or as near, and its number of near lines."""
    lines = _lines(docs)
    spots = work.cut(lines.select("doc", "body", "at", "place", "h", "g", _keys(F.col("line")).alias("keys")), "spots")
    same = spots.groupBy("h", "g").agg(F.count("*").alias("many"), F.min("place").alias("first"))
    keys = spots.select("h", F.explode("keys").alias("key"))
    met = work.cut(keys.groupBy(F.col("key").alias("met")).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("met"), "met")
    marked = work.cut(keys.join(met, F.col("key") == F.col("met")).select(F.col("h").alias("marked")).distinct(), "marked")
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    few = lines.join(marked, F.col("h") == F.col("marked")).groupBy("line").agg(F.min("place").alias("first"))
    few = work.cut(few.withColumns({"id": F.monotonically_increasing_id(), "sketch": _sketch(F.col("line")), "chars": F.split("line", "")}), "few")
    pairs = work.cut(_pairs(few, limit), "near")
    ends = pairs.select(F.col("a").alias("one"), F.col("b").alias("two")).union(pairs.select("b", "a"))
    firsts = few.select("id", "first")
    ends = ends.join(firsts.toDF("i", "own"), F.col("one") == F.col("i")).join(firsts.toDF("j", "its"), F.col("two") == F.col("j"))
    linked = ends.groupBy("one").agg(F.count("*").alias("links"), F.max(F.col("its") < F.col("own")).alias("late"))
    linked = few.join(linked, F.col("id") == F.col("one")).select(F.xxhash64("line").alias("p"), F.xxhash64(F.lit(THRESHOLD), "line").alias("q"), "links", "late")
    known = same.join(linked, (F.col("h") == F.col("p")) & (F.col("g") == F.col("q")), "left").where((F.col("many") > 1) | F.col("links").isNotNull())
    known = work.cut(known.select(F.col("h").alias("p"), F.col("g").alias("q"), "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("late", F.lit(False)).alias("late")), "known")
    met = spots.join(known, (F.col("h") == F.col("p")) & (F.col("g") == F.col("q")))
    equal = F.col("place") > F.col("first")
    return met.select("doc", "body", "at", equal.alias("equal"), (~equal & F.col("late")).alias("near"), "links")


def dedup_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents' columns with dropped lines taken out of ``text``, and
    n_lines, n_equal, n_near and n_links beside them as ``_n_...``.

    A null text stays null and has no lines; a text without droppable lines
    stays as it is, to the byte. Rows with a null doc_id count as one document
    behind all others; rows of one doc_id are told apart by their text, and
    repeated rows are treated alike. Extra columns pass through."""
    found = decisions(docs, limit)
    per = work.cut(
        found.groupBy("doc", "body").agg(
            F.sort_array(F.collect_set(F.when(F.col("equal") | F.col("near"), F.col("at")))).alias("_out"),
            F.countDistinct(F.when(F.col("equal"), F.col("at"))).alias("_n_equal"),
            F.countDistinct(F.when(F.col("near"), F.col("at"))).alias("_n_near"),
            F.sum("links").alias("_n_links"),
        ),
        "per",
    )
    own = docs.withColumns({"_doc": F.col("doc_id").cast("bigint"), "_body": F.xxhash64("text")})
    joined = own.join(per, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_body") == F.col("body")), "left")
    parts = F.split("text", "\n")
    kept = F.filter(F.arrays_zip(parts.alias("x"), F.sequence(F.lit(0), F.size(parts) - 1).alias("i")), lambda z: ~F.array_contains("_out", z["i"]))
    text = F.when(F.size("_out") > 0, F.array_join(F.transform(kept, lambda z: z["x"]), "\n")).otherwise(F.col("text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("_n_lines"), *(zero(c).alias(c) for c in ("_n_equal", "_n_near", "_n_links")))


def op10_line_edit(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(work.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", *(F.col("_" + c).alias(c) for c in ("n_lines", "n_equal", "n_near", "n_links")))
