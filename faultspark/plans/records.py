"""Queries of waveforms, names, logs, evaluation and mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultspark.functions import bits, names, rv64i
from faultspark.operators import blocks, evaluate, mutate, wave
from faultspark.plans import fixtures as fx
from faultspark.plans.registry import query
from faultspark.sources import logs

SIGNALS = ["click", "error", "purchase", "signup", "view"]

# Waveforms

HELD = """WITH c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
  p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
  j AS (SELECT p.event_id, p.user_id, c.value AS found FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts)
"""


def _held(spark, sf_dir):
    rows = fx.changes(spark, sf_dir)
    probes = rows.where("event_type = 'click'").select("event_id", "user_id", "time")
    return wave.as_of(probes, rows.where("event_type = 'purchase'"), ["user_id"], seq="event_id")


@query("wave_asof", HELD + "SELECT event_id, user_id, found FROM j")
def wave_asof(spark, sf_dir):
    return _held(spark, sf_dir).select("event_id", "user_id", "found")


@query(
    "wave_asof_batch",
    """WITH c AS (SELECT user_id % 100 AS signal, ts, value FROM events WHERE event_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id % 100, ts ORDER BY event_id) = 1),
       p AS (SELECT event_id, user_id % 100 AS signal, ts FROM events WHERE event_id % 10 = 0)
       SELECT p.event_id, p.signal, c.value AS found FROM p ASOF LEFT JOIN c ON p.signal = c.signal AND p.ts >= c.ts""",
)
def wave_asof_batch(spark, sf_dir):
    rows = fx.changes(spark, sf_dir).withColumn("signal", F.col("user_id") % 100)
    probes = rows.where("event_id % 10 = 0").select("event_id", "signal", "time")
    return wave.as_of(probes, rows.where("event_id % 10 <> 0"), ["signal"], seq="event_id").select("event_id", "signal", "found")


@query("wave_unknown", HELD + "SELECT user_id, count(*) AS n FROM j WHERE found IS NULL GROUP BY user_id")
def wave_unknown(spark, sf_dir):
    return _held(spark, sf_dir).where("found IS NULL").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "wave_compact",
    "SELECT event_id, user_id, v FROM (SELECT *, floor(value / 50)::BIGINT AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w = 1 OR v IS DISTINCT FROM lag(v) OVER w",
)
def wave_compact(spark, sf_dir):
    rows = fx.changes(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 50).cast("bigint"))
    return wave.compact(rows, ["user_id"], ["time", "event_id"], "v").select("event_id", "user_id", "v")


@query("wave_delta_groups", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS elements, min(event_id) AS first_seq, min_by(value, event_id) AS first_value FROM events GROUP BY 1, 2")
def wave_delta_groups(spark, sf_dir):
    rows = fx.changes(spark, sf_dir).withColumn("day", F.date_format("time", "yyyy-MM-dd"))
    return wave.delta_groups(rows, ["event_type"], "day", "event_id")


@query("wave_next_change", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events")
def wave_next_change(spark, sf_dir):
    return wave.next_change(fx.changes(spark, sf_dir), ["user_id"], ["time", "event_id"], "event_id").select("event_id", "next")


@query(
    "wave_monotonic",
    "SELECT event_id, user_id FROM events QUALIFY coalesce(ts >= max(ts) OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)",
)
def wave_monotonic(spark, sf_dir):
    rows = fx.changes(spark, sf_dir).withColumn("arrival", F.col("event_id") * 7919 % 10007)
    return wave.monotonic(rows, ["user_id"], ["arrival", "event_id"]).select("event_id", "user_id")


@query("wave_enum_map", "SELECT event_id, coalesce(n_name, (event_id % 30)::VARCHAR) AS shown FROM events LEFT JOIN nation ON event_id % 30 = n_nationkey")
def wave_enum_map(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 30).alias("raw"))
    enum_map = fx.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("raw"), F.col("n_name").alias("name"))
    return wave.map_enum(rows, enum_map, "raw", "shown").select("event_id", "shown")


@query("wave_hex", "SELECT DISTINCT l_partkey AS n, '0x' || lpad(lower(to_hex(l_partkey)), 8, '0') AS shown FROM lineitem")
def wave_hex(spark, sf_dir):
    return fx.load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("n")).distinct().withColumn("shown", bits.hex_value(F.col("n"), 8))


@query("wave_bit_slice", "SELECT p_partkey AS n, substring(lpad(bin(p_partkey), 32, '0'), 32 - 9, 6) AS cut FROM part")
def wave_bit_slice(spark, sf_dir):
    value = F.lpad(F.bin("p_partkey"), 32, "0")
    return fx.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), bits.bit_slice(value, F.lit(9), F.lit(4)).alias("cut"))


STATES = "SELECT p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN bin(p_partkey) WHEN 1 THEN 'x' || bin(p_partkey) WHEN 2 THEN 'h' || bin(p_partkey) ELSE 'q' || bin(p_partkey) END AS v FROM part"


def _states(spark, sf_dir):
    n = F.col("p_partkey")
    head = F.when(n % 4 == 0, "").when(n % 4 == 1, "x").when(n % 4 == 2, "h").otherwise("q")
    return fx.load(spark, sf_dir, "part").select(n.alias("n"), F.concat(head, F.bin(n)).alias("v"))


@query("wave_state_class", f"SELECT n, CASE WHEN regexp_full_match(v, '[01]+') THEN 0 WHEN regexp_full_match(v, '[01xz]+') THEN 1 WHEN regexp_full_match(v, '[01xzhuwl-]+') THEN 2 END AS states FROM ({STATES})")
def wave_state_class(spark, sf_dir):
    return _states(spark, sf_dir).select("n", bits.state_class(F.col("v")).alias("states"))


@query("wave_extend", f"SELECT n, CASE WHEN length(v) < 20 AND left(v, 1) IN ('0', '1') THEN lpad(v, 20, '0') WHEN length(v) < 20 AND left(v, 1) IN ('x', 'z') THEN lpad(v, 20, left(v, 1)) END AS wide FROM ({STATES})")
def wave_extend(spark, sf_dir):
    return _states(spark, sf_dir).select("n", bits.extend(F.col("v"), F.lit(20)).alias("wide"))


@query(
    "wave_scope_suffix_match",
    fx.with_sql("scopes") + """, asked AS (SELECT 'TOP.' || path AS asked FROM scopes),
      known AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN n_name || '.' || c ELSE c END AS known FROM scopes WHERE c_custkey % 6 <> 5)
      SELECT asked, known, len(string_split(known, '.'))::BIGINT AS segments FROM asked JOIN known ON ends_with(asked, '.' || known)""",
)
def wave_scope_suffix_match(spark, sf_dir):
    paths = fx.scopes(spark, sf_dir)
    asked = paths.select(F.concat(F.lit("TOP."), "path").alias("path"))
    tail = lambda n: F.substring_index("path", ".", -n)
    known = paths.where("c_custkey % 6 <> 5").select(F.when(F.col("c_custkey") % 2 == 0, tail(2)).otherwise(tail(1)).alias("path"))
    return wave.match_scopes(asked, known)


@query("wave_table", "SELECT user_id, " + ", ".join(f"min(value) FILTER (WHERE event_type = '{s}') AS {s}" for s in SIGNALS) + " FROM events GROUP BY user_id")
def wave_table(spark, sf_dir):
    return wave.table(fx.changes(spark, sf_dir), "user_id", "event_type", "value", SIGNALS)


@query(
    "probe_start",
    "SELECT user_id, coalesce(min(event_id) FILTER (WHERE value IS NOT NULL AND floor(value) % 3 <> 0), max(event_id)) AS start FROM events GROUP BY user_id",
)
def probe_start(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("time"), (F.floor("value") % 3).alias("value"))
    return wave.probe_start(rows, ["user_id"])


# Names and text


@query("scope_parent", fx.with_sql("scopes") + "SELECT path, r_name || '.' || n_name AS parent FROM scopes UNION ALL SELECT DISTINCT r_name, NULL FROM scopes")
def scope_parent(spark, sf_dir):
    paths = fx.scopes(spark, sf_dir).select("path")
    tops = paths.select(F.substring_index("path", ".", 1).alias("path")).distinct()
    return paths.unionByName(tops).withColumn("parent", names.parent_scope(F.col("path")))


@query("signal_suffix", "SELECT p_partkey, list_aggregate(list_slice(string_split(replace(p_name, ' ', '_'), '_'), -2, -1), 'string_agg', '_') AS suffix FROM part")
def signal_suffix(spark, sf_dir):
    return fx.load(spark, sf_dir, "part").select("p_partkey", names.signal_suffix(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("suffix"))


@query(
    "canonical_name",
    """WITH m AS (SELECT p_size AS module, p_brand AS port, min(p_name) AS canonical FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2), o AS (SELECT port, min(canonical) AS canonical FROM m GROUP BY port)
       SELECT p_partkey, coalesce(m.canonical, o.canonical, 'none') AS canonical FROM part LEFT JOIN m ON m.module = p_size AND m.port = p_brand LEFT JOIN o ON o.port = p_brand""",
)
def canonical_name(spark, sf_dir):
    part = fx.load(spark, sf_dir, "part")
    name_map = part.where("p_partkey % 3 = 0").groupBy(F.col("p_size").alias("module"), F.col("p_brand").alias("port")).agg(F.min("p_name").alias("canonical"))
    rows = part.select("p_partkey", F.col("p_size").alias("module"), F.col("p_brand").alias("port"))
    return blocks.canonical_signals(rows, name_map, F.lit("none")).select("p_partkey", "canonical")


@query(
    "canonical_port",
    """WITH p AS (SELECT p_partkey, (['io_in_bits_', 'io_out_bits_', 'io_in_', 'io_out_', 'io_', ''])[p_partkey % 6 + 1] || (['data', 'valid', 'pc', 'redirect', 'target', 'clock', 'x'])[p_partkey % 7 + 1] AS port FROM part),
       s AS (SELECT p_partkey, port, regexp_replace(port, '^(io_in_bits_|io_out_bits_|io_in_|io_out_|io_)', '') AS short FROM p)
       SELECT p_partkey, port, CASE WHEN length(short) >= 4 AND short NOT IN ('data', 'valid', 'ready', 'bits', 'clock', 'reset') THEN short END AS canonical FROM s""",
)
def canonical_port(spark, sf_dir):
    pick = lambda items: F.get(F.array(*map(F.lit, items)), (F.col("p_partkey") % len(items)).cast("int"))
    port = F.concat(pick([*names.PORT_PREFIXES, ""]), pick(["data", "valid", "pc", "redirect", "target", "clock", "x"]))
    return fx.load(spark, sf_dir, "part").select("p_partkey", port.alias("port")).withColumn("canonical", names.canonical_port(F.col("port")))


@query("const_filter", "SELECT p_brand, p_type, regexp_replace(p_type, '[^A-Za-z]', '', 'g') = upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS constant, p_brand = p_type AS same FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def const_filter(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return rows.withColumns({"constant": names.is_constant(F.col("p_type")), "same": F.col("p_brand") == F.col("p_type")})


@query(
    "pos_from_offset",
    """WITH d AS (SELECT page_id, 'abc' || chr(10) || url || chr(10) || chr(10) || 'zß' AS t, page_id % 60 AS o FROM pages),
       b AS (SELECT page_id, o, hex(encode(t)) AS h FROM d), p AS (SELECT page_id, o, length(h) // 2 AS n, left(h, 2 * (o + 1)::INT) AS u FROM b),
       x AS (SELECT page_id, o, n, list_filter(range(1, (o + 2)::BIGINT), lambda i: substring(u, (2 * i - 1)::INT, 2) = '0A') AS l FROM p)
       SELECT page_id, CASE WHEN o < n THEN o + 1 - coalesce(list_max(l), 0) END AS col, CASE WHEN o < n THEN len(l) + 1 END AS row FROM x""",
)
def pos_from_offset(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("abc\n"), "url", F.lit("\n\nzß")).alias("t"), (F.col("page_id") % 60).alias("o"))
    return rows.select("page_id", names.position(F.col("t"), F.col("o")).alias("p")).select("page_id", F.col("p.column").alias("col"), F.col("p.row").alias("row"))


@query("line_ranges", "SELECT p_partkey, unnest(list_distinct(list_concat([p_size], range(p_size + 2, p_size + 2 + p_size % 4))))::INT AS line FROM part")
def line_ranges(spark, sf_dir):
    size = F.col("p_size")
    text = F.concat(size.cast("string"), F.when(size % 4 > 0, F.concat(F.lit(","), (size + 2).cast("string"), F.lit("-"), (size + 1 + size % 4).cast("string"))).otherwise(""))
    return fx.load(spark, sf_dir, "part").select("p_partkey", F.explode(names.parse_numbers(text)).alias("line"))


@query(
    "param_json_lines",
    """WITH j AS (SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events) SELECT event_type, line, count(*) AS n FROM
       (SELECT event_type, unnest(range(k, k + 3)) AS line FROM j JOIN events USING (event_id)) GROUP BY ALL""",
)
def param_json_lines(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    loc = F.concat(F.lit("f.sv,"), k, F.lit(":1,"), (k.cast("int") + 2).cast("string"), F.lit(":9"))
    rows = fx.load(spark, sf_dir, "events").select("event_type", F.explode(F.transform(names.location_lines(loc), lambda x: x.cast("bigint"))).alias("line"))
    return rows.groupBy("event_type", "line").agg(F.count("*").alias("n"))


@query(
    "levenshtein_nearest",
    """WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), f AS (SELECT name, CASE WHEN regexp_matches(name, '[A-Z]') THEN upper(name) ELSE name END AS n FROM t),
       x AS (SELECT a.name, b.name AS other, levenshtein(a.n, b.n)::BIGINT AS distance FROM f a JOIN f b ON a.name <> b.name)
       SELECT name, other, distance FROM x QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, other) = 1""",
)
def levenshtein_nearest(spark, sf_dir):
    return mutate.nearest_names(fx.load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")))


MUTATIONS = "(['" + "', '".join([*mutate.OPERATORS, "^", "~"]) + "'])"


@query("mutation_operator_map", f"SELECT event_id, {MUTATIONS}[event_id % 16 + 1] AS op, (['" + "', '".join(mutate.OPERATORS.values()) + "', NULL, NULL])[event_id % 16 + 1] AS mutated FROM events")
def mutation_operator_map(spark, sf_dir):
    ops = F.array(*map(F.lit, [*mutate.OPERATORS, "^", "~"]))
    rows = fx.load(spark, sf_dir, "events").select("event_id", F.get(ops, (F.col("event_id") % 16).cast("int")).alias("op"))
    return rows.withColumn("mutated", mutate.mutated(F.col("op")))


@query("splice", "SELECT p_partkey, left(p_name, 2) || 'XY' || substring(p_name, 6) AS text FROM part")
def splice(spark, sf_dir):
    return fx.load(spark, sf_dir, "part").select("p_partkey", mutate.spliced(F.col("p_name"), F.lit(2), F.lit(3), F.lit("XY")).alias("text"))


# Votes and evaluation


@query("vote_topk", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def vote_topk(spark, sf_dir):
    return evaluate.top_items(fx.load(spark, sf_dir, "events").select("user_id"), "user_id", 10)


@query("vote_thresholds", "SELECT user_id, avg((event_type <> 'click')::INT) > 0.5 AS skip, avg((event_type IN ('view', 'error'))::INT) >= 0.5 AS suspicious, avg((value > 50)::INT) > 0.5 AS terminate FROM events GROUP BY 1")
def vote_thresholds(spark, sf_dir):
    kind = F.col("event_type")
    votes = fx.load(spark, sf_dir, "events").select("user_id", (kind == "click").alias("dive"), kind.isin("view", "error").alias("suspicious"), (F.col("value") > 50).alias("terminate"))
    return evaluate.vote(votes, ["user_id"])


RANKED = fx.with_sql("truth") + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem),
  found AS (SELECT bug_id, min(rank) FILTER (WHERE l_suppkey = module AND l_partkey = block_id) AS rank FROM truth JOIN ranked ON l_orderkey = bug_id GROUP BY bug_id)"""


def _hits(spark, sf_dir):
    ranked = evaluate.ranked(fx.predictions(spark, sf_dir), ties=["l_linenumber", "block_id", "module"])
    return evaluate.hits(fx.truth(spark, sf_dir), ranked, ["module", "block_id"])


@query("eval_topk", RANKED + " SELECT count(*) AS bugs, count(*) FILTER (WHERE rank <= 1) AS top1, count(*) FILTER (WHERE rank <= 5) AS top5, count(*) FILTER (WHERE rank <= 10) AS top10, count(rank) AS top_any FROM found")
def eval_topk(spark, sf_dir):
    return evaluate.top_counts(_hits(spark, sf_dir))


@query("eval_cost", RANKED + " SELECT count(*) AS hits, avg(o_custkey) AS avg_tokens, round(avg((o_custkey % 64) / 64.0::DOUBLE), 9) AS avg_price FROM found JOIN orders ON o_orderkey = bug_id WHERE rank = 1")
def eval_cost(spark, sf_dir):
    usage = fx.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bug_id"), F.col("o_custkey").alias("tokens"), ((F.col("o_custkey") % 64) / 64.0).alias("price"))
    return evaluate.cost(_hits(spark, sf_dir), usage).withColumn("avg_price", F.round("avg_price", 9))


TRACES = fx.with_sql("truth") + """, t AS (SELECT l_orderkey AS bug, l_partkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_linenumber DESC, l_suppkey DESC) AS back FROM lineitem),
  best AS (SELECT bug_id, min(back) AS back FROM truth JOIN t ON bug = bug_id AND block = block_id WHERE back <= 10 GROUP BY bug_id)"""


def _traces(spark, sf_dir):
    return fx.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bug_id"), F.struct("l_shipdate", "l_partkey", "l_linenumber", "l_suppkey").alias("seq"), F.col("l_partkey").alias("block_id"))


@query("eval_trace", TRACES + " SELECT k, (SELECT count(*) FROM best WHERE back <= k) AS hits FROM range(1, 11) r(k)")
def eval_trace(spark, sf_dir):
    return evaluate.trace_tops(_traces(spark, sf_dir), fx.truth(spark, sf_dir))


@query("eval_trace_summary", TRACES + " SELECT (SELECT count(*) FROM truth) AS bugs, (SELECT count(DISTINCT bug_id) FROM truth JOIN t ON bug = bug_id AND block = block_id) AS hits, (SELECT avg(n) FROM (SELECT count(*) AS n FROM t GROUP BY bug)) AS avg_size")
def eval_trace_summary(spark, sf_dir):
    return evaluate.trace_summary(_traces(spark, sf_dir), fx.truth(spark, sf_dir))


@query("latest_run", "SELECT user_id, event_id, event_id * 31 % 97 AS n FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id * 31 % 97 DESC, event_id) = 1")
def latest_run(spark, sf_dir):
    runs = fx.load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 31 % 97).alias("n"))
    return evaluate.latest_runs(runs, "user_id", "n", ["event_id"])


@query("first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(spark, sf_dir):
    return evaluate.first_wins(fx.load(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("nav_first_wins", "SELECT signal, min_by(bid, seq) AS bid FROM (SELECT l_suppkey AS signal, l_partkey AS bid, l_orderkey * 100 + l_linenumber * 10 AS seq FROM lineitem UNION ALL SELECT l_partkey + 1000000, l_partkey, l_orderkey * 100 + l_linenumber * 10 + 1 FROM lineitem) GROUP BY signal HAVING count(*) > 0 AND min_by(bid, seq) IS NOT NULL AND count(DISTINCT seq) = count(*)")
def nav_first_wins(spark, sf_dir):
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    rows = fx.load(spark, sf_dir, "lineitem")
    drivers = rows.select(F.col("l_suppkey").alias("signal"), F.col("l_partkey").alias("bid"), seq.alias("seq"))
    own = rows.select((F.col("l_partkey") + 1000000).alias("signal"), F.col("l_partkey").alias("bid"), (seq + 1).alias("seq"))
    both = drivers.unionByName(own)
    clear = both.groupBy("signal").agg((F.countDistinct("seq") == F.count("*")).alias("clear")).where("clear").select("signal")
    return evaluate.first_wins(both.join(clear, "signal", "left_semi"), ["signal"], ["seq"]).select("signal", "bid")


@query("nav_first_wins_ties", "SELECT signal, bid FROM (SELECT l_suppkey AS signal, l_partkey AS bid, l_orderkey * 100 + l_linenumber * 10 AS seq FROM lineitem UNION ALL SELECT l_partkey + 1000000, l_partkey, l_orderkey * 100 + l_linenumber * 10 + 1 FROM lineitem) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY seq, bid) = 1")
def nav_first_wins_ties(spark, sf_dir):
    """``nav_first_wins`` of every signal; the smaller bid wins a tie."""
    seq = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    rows = fx.load(spark, sf_dir, "lineitem")
    drivers = rows.select(F.col("l_suppkey").alias("signal"), F.col("l_partkey").alias("bid"), seq.alias("seq"))
    own = rows.select((F.col("l_partkey") + 1000000).alias("signal"), F.col("l_partkey").alias("bid"), (seq + 1).alias("seq"))
    return evaluate.first_wins(drivers.unionByName(own), ["signal"], ["seq", "bid"]).select("signal", "bid")


# Logs


def _hex(c: str, digits: int = 0) -> str:
    return f"lpad(lower(to_hex({c})), {digits}, '0')" if digits else f"lower(to_hex({c}))"


@query("log_mismatch", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Pc' WHEN 1 THEN 'Wdata' END AS kind, CASE WHEN event_id % 3 < 2 THEN event_id * 17 END AS oracle, CASE event_id % 3 WHEN 0 THEN user_id END AS dut, CASE event_id % 3 WHEN 2 THEN event_id END AS failure_time FROM events")
def log_mismatch(spark, sf_dir):
    e, shown = F.col("event_id"), lambda c: F.lower(F.hex(c))
    spoken = F.concat(F.lit("PC mismatch, DUT retired : "), shown(F.col("user_id")), F.lit(" , but the ISS retired: "), shown(e * 17))
    line = F.when(e % 3 == 0, spoken).when(e % 3 == 1, F.concat(F.lit("x WDATA_MISMATCH ORACLE="), shown(e * 17))).otherwise(F.concat(F.lit("FAILURE: Co-simulation mismatch at time       "), e.cast("string")))
    rows = fx.load(spark, sf_dir, "events").select("event_id", logs.mismatch(line).alias("m")).select("event_id", "m.*")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("oracle", "dut")})


@query("log_trace", "SELECT event_id, event_id % 3 // 2 AS core, event_id * 4 AS pc, user_id * 7 AS encoding, CASE event_id % 3 WHEN 2 THEN 'j pc + 0x9f38' WHEN 1 THEN 'jal x0,f6148' ELSE 'ret' END AS instruction FROM events")
def log_trace(spark, sf_dir):
    e, shown = F.col("event_id"), lambda c: F.lower(F.hex(c))
    pc, word = shown(e * 4), shown(F.col("user_id") * 7)
    spoken = F.concat(F.lit("core 1: 0x"), pc, F.lit(" (0x"), word, F.lit(") j pc + 0x9f38"))
    table = F.concat(F.lit("  20  6  "), pc, F.lit("  "), word)
    line = F.when(e % 3 == 2, spoken).when(e % 3 == 1, F.concat(table, F.lit("  jal x0,f6148  x0=0"))).otherwise(F.concat(table, F.lit("  ret")))
    rows = fx.load(spark, sf_dir, "events").select("event_id", logs.instruction(line).alias("i")).select("event_id", "i.*")
    return rows.withColumns({"core": F.col("core").cast("bigint"), "pc": F.col("pc").cast("bigint")})


@query("log_commit_dedupe", "SELECT user_id, event_id % 8 AS idx, min(event_id) AS pc, min_by(user_id * 3, event_id) AS data FROM events GROUP BY 1, 2")
def log_commit_dedupe(spark, sf_dir):
    e, shown = F.col("event_id"), lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    line = F.concat(F.lit("["), (e % 8).cast("string"), F.lit("] commit pc "), shown(e, 16), F.lit(" inst 00008067 wen 1 dst 05 data "), shown(F.col("user_id") * 3, 16), F.lit(" idx 000"))
    text = fx.load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(e.alias("e"), line.alias("l")))).alias("x")).select("user_id", F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("log"))
    rows = text.select("user_id", F.explode(logs.commits(F.col("log"))).alias("c"))
    return rows.select("user_id", F.col("c.idx").cast("bigint").alias("idx"), F.col("c.pc").cast("bigint").alias("pc"), F.col("c.data").cast("bigint").alias("data"))


@query(
    "test_report",
    f"""SELECT event_id, event_id - 1 - 2 AS start_time, event_id - 3 - 8 AS time_bound,
        'Now this core design is buggy when executing a instruction. jalr this instruction writes wrong data 0x' || {_hex('user_id', 8)} || ' to register which should write data 0x' || {_hex('event_id', 8)} || '.' || chr(10) || chr(10) AS report FROM events""",
)
def test_report(spark, sf_dir):
    e, step = F.col("event_id"), F.lit(2)
    start = logs.start_time(e, step)
    return fx.load(spark, sf_dir, "events").select("event_id", start.alias("start_time"), logs.time_bound(start, step).alias("time_bound"), logs.report_text(F.lit("Wdata"), F.lit("jalr"), F.col("user_id"), e).alias("report"))


POINT = "chr(1) || 'f' || chr(2) || event_type || '.sv' || chr(1) || 'l' || chr(2) || (event_id % 90)::VARCHAR || chr(1) || 'h' || chr(2) || 'TOP.u' || user_id::VARCHAR"


def _points(spark, sf_dir):
    e = F.col("event_id")
    point = F.concat(F.lit("\x01f\x02"), "event_type", F.lit(".sv\x01l\x02"), (e % 90).cast("string"), F.lit("\x01h\x02TOP.u"), F.col("user_id").cast("string"))
    line = F.when(e % 5 == 0, F.lit("# header")).when(e % 5 == 1, F.concat(F.lit("C '"), point, F.lit("' many"))).otherwise(F.concat(F.lit("C '"), point, F.lit("' "), (e % 7).cast("string")))
    return fx.load(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("vlc_parse", f"SELECT event_id, {POINT} AS point, event_id % 7 AS count FROM events WHERE event_id % 5 > 1")
def vlc_parse(spark, sf_dir):
    return _points(spark, sf_dir).select("event_id", logs.coverage_line(F.col("line")).alias("c")).where("c IS NOT NULL").select("event_id", "c.*")


@query("vlc_keys", "SELECT event_id, event_type || '.sv' AS file, 'TOP.u' || user_id AS hierarchy, (event_id % 90)::INT AS lineno, 0 AS col FROM events WHERE event_id % 5 > 1")
def vlc_keys(spark, sf_dir):
    point = F.col("c.point")
    rows = _points(spark, sf_dir).select("event_id", logs.coverage_line(F.col("line")).alias("c")).where("c IS NOT NULL")
    return rows.select("event_id", logs.point_key(point, "f").alias("file"), logs.point_key(point, "h").alias("hierarchy"), logs.point_number(point, "l").alias("lineno"), logs.point_number(point, "n").alias("col"))


@query("vcd_ids", "SELECT p_partkey, chr((33 + p_partkey % 94)::INT) || chr((33 + p_partkey % 89)::INT) AS code, (p_partkey % 94 + 1) + (p_partkey % 89 + 1) * 94 - 1 AS id FROM part")
def vcd_ids(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.concat(F.chr(33 + k % 94), F.chr(33 + k % 89))
    return fx.load(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("id", bits.vcd_id(F.col("code")))


REGISTER_SQL = "(['" + "', '".join(rv64i.REGISTERS) + "'])"
WORDS = "(SELECT DISTINCT (l_partkey * 2654435761 + l_orderkey * 40503) % 4294967296 // 128 * 128 + ([55, 23, 111, 103, 99, 3, 35, 19, 51, 27, 59, 115, 15, 127])[l_orderkey % 14 + 1] AS w FROM lineitem)"


def _pick(kinds: dict, unknown: str) -> str:
    return "CASE f3 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in kinds.items()) + f" ELSE '{unknown}' || f3 END"


DECODE_SQL = f"""WITH a AS (SELECT w, w & 127 AS op, (w >> 12) & 7 AS f3, (w >> 25) & 127 AS f7, (w >> 20) & 4095 AS csr, {REGISTER_SQL}[((w >> 7) & 31) + 1] AS rd,
    {REGISTER_SQL}[((w >> 15) & 31) + 1] AS r1, {REGISTER_SQL}[((w >> 20) & 31) + 1] AS r2,
    (((w >> 20) & 4095) + 2048) % 4096 - 2048 AS ii, ((((w >> 25) & 127) * 32 + ((w >> 7) & 31)) + 2048) % 4096 - 2048 AS si,
    (((w >> 8) & 15) * 2 + ((w >> 25) & 63) * 32 + ((w >> 7) & 1) * 2048 + (w >> 31) * 4096 + 4096) % 8192 - 4096 AS bi,
    (((w >> 21) & 1023) * 2 + ((w >> 20) & 1) * 2048 + ((w >> 12) & 255) * 4096 + (w >> 31) * 1048576 + 1048576) % 2097152 - 1048576 AS ji, (w >> 20) & 63 AS sh FROM {WORDS})
  SELECT w, CASE op WHEN 55 THEN 'lui' WHEN 23 THEN 'auipc' WHEN 111 THEN 'jal' WHEN 103 THEN 'jalr' WHEN 99 THEN {_pick(rv64i.BRANCH, 'b?')} WHEN 3 THEN {_pick(rv64i.LOAD, 'l?')}
    WHEN 35 THEN {_pick(rv64i.STORE, 's?')} WHEN 19 THEN CASE WHEN f3 = 1 THEN 'slli' WHEN f3 = 5 THEN CASE WHEN f7 = 16 THEN 'srai' ELSE 'srli' END ELSE {_pick(rv64i.IMMEDIATE, 'op-imm?')} END
    WHEN 51 THEN CASE f3 * 1000 + f7 {" ".join(f"WHEN {k[0] * 1000 + k[1]} THEN '{v}'" for k, v in rv64i.REGISTER.items())} ELSE 'op?' || f3 || '.' || f7 END
    WHEN 27 THEN CASE WHEN f3 = 0 THEN 'addiw' WHEN f3 = 1 THEN 'slliw' WHEN f3 = 5 THEN CASE WHEN f7 = 16 THEN 'sraiw' ELSE 'srliw' END ELSE 'unknown' END
    WHEN 59 THEN CASE WHEN f3 = 0 AND f7 = 0 THEN 'addw' WHEN f3 = 0 AND f7 = 32 THEN 'subw' ELSE 'unknown' END
    WHEN 115 THEN CASE WHEN f3 > 0 THEN {_pick(rv64i.CSR, 'system?')} WHEN w >> 20 = 0 THEN 'ecall' WHEN w >> 20 = 1 THEN 'ebreak' WHEN csr = 261 THEN 'wfi' WHEN csr = 288 THEN 'sfence.vma' WHEN f7 = 9 THEN 'sfmt' WHEN csr = 770 THEN 'mret' ELSE 'priv' END
    WHEN 15 THEN CASE f3 WHEN 0 THEN 'fence' WHEN 1 THEN 'fence.i' ELSE 'unknown' END ELSE 'unknown' END AS mnemonic,
    CASE WHEN op IN (55, 23) THEN rd || ', 0x' || lower(to_hex((w >> 12) & 1048575)) WHEN op = 111 THEN rd || ', ' || ji WHEN op IN (103, 3) THEN rd || ', ' || ii || '(' || r1 || ')'
    WHEN op = 99 THEN r1 || ', ' || r2 || ', ' || bi WHEN op = 35 THEN r2 || ', ' || si || '(' || r1 || ')' WHEN op = 19 AND f3 IN (1, 5) THEN rd || ', ' || r1 || ', ' || sh
    WHEN op = 19 THEN rd || ', ' || r1 || ', ' || ii WHEN op = 51 THEN rd || ', ' || r1 || ', ' || r2 WHEN op = 27 AND f3 = 0 THEN rd || ', ' || r1 || ', ' || ii
    WHEN op = 27 AND f3 IN (1, 5) THEN rd || ', ' || r1 || ', ' || sh WHEN op = 59 AND f3 = 0 AND f7 IN (0, 32) THEN rd || ', ' || r1 || ', ' || r2
    WHEN op = 115 AND f3 > 0 THEN rd || ', 0x' || lower(to_hex(csr)) || ', ' || r1
    WHEN op = 115 THEN CASE WHEN w >> 20 IN (0, 1) OR csr = 261 OR f7 = 9 AND csr <> 288 THEN '' WHEN csr = 288 THEN CASE WHEN (w >> 15) & 1023 = 0 THEN 'sfence.vma' ELSE r1 || ', ' || r2 END ELSE '0x' || lower(to_hex(csr)) END
    WHEN op = 15 AND f3 < 2 THEN '' ELSE '0x' || lpad(lower(to_hex(w)), 8, '0') END AS operands FROM a"""


@query("decode_rv64i", DECODE_SQL)
def decode_rv64i(spark, sf_dir):
    code = F.array(*map(F.lit, [55, 23, 111, 103, 99, 3, 35, 19, 51, 27, 59, 115, 15, 127]))
    mixed = (F.col("l_partkey") * 2654435761 + F.col("l_orderkey") * 40503) % 4294967296
    word = (mixed - mixed % 128 + F.get(code, (F.col("l_orderkey") % 14).cast("int"))).cast("bigint")
    return fx.load(spark, sf_dir, "lineitem").select(word.alias("w")).distinct().select("w", rv64i.decode(F.col("w")).alias("d")).select("w", "d.*")


@query("diff_first_added", "SELECT doc_id, nullif(trim(regexp_replace(trim(split_part(text, chr(10), 2)), '//.*$', '')), '') AS line FROM documents")
def diff_first_added(spark, sf_dir):
    second = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    diff = F.concat(F.lit("--- a\n+++ b\n context\n+   \n+"), second, F.lit("\n-gone"))
    return fx.load(spark, sf_dir, "documents").select("doc_id", F.nullif(logs.first_added(diff), F.lit("")).alias("line"))


@query(
    "oracle_validate",
    """SELECT CASE WHEN quality IS NULL THEN 'error' WHEN contains(text, CASE WHEN quality = 1 THEN split_part(text, chr(10), 1) ELSE 'never here' END) THEN 'consistent' ELSE 'mismatch' END AS status, count(*) AS n
       FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1""",
)
def oracle_validate(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    told = fx.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("bug_id"), "quality")
    first = docs.select(F.col("doc_id").alias("bug_id"), F.split("text", "\n")[0].alias("first"))
    diffs = told.join(first, "bug_id", "left").select("bug_id", F.when(F.col("quality") == 1, F.col("first")).when(F.col("quality") == 0, "never here").alias("line"))
    return mutate.validate(diffs, docs.select(F.col("doc_id").alias("bug_id"), F.col("text").alias("ctx"))).groupBy("status").agg(F.count("*").alias("n"))


PRICE_SQL = " ".join(f"WHEN '{m}' THEN {i}::DOUBLE * a / 1000000.0 + {o}::DOUBLE * b / 1000000.0" for m, (i, o) in evaluate.PRICES.items())


@query("token_price", f"SELECT conv_id, turn, model, round(CASE model {PRICE_SQL} END, 12) AS price FROM (SELECT conv_id, turn, length(text) AS a, length(role) AS b, (['gpt-4o', 'o3-mini', 'claude-3-haiku-20240307', 'unknown'])[(conv_id + turn) % 4 + 1] AS model FROM conversations)")
def token_price(spark, sf_dir):
    model = F.get(F.array(*map(F.lit, ["gpt-4o", "o3-mini", "claude-3-haiku-20240307", "unknown"])), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    rows = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", model.alias("model"), F.char_length("text").alias("a"), F.char_length("role").alias("b"))
    return rows.select("conv_id", "turn", "model", F.round(evaluate.token_price(F.col("model"), F.col("a"), F.col("b")), 12).alias("price"))


@query("json_fence", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"n": ' || conv_id || '}' WHEN 1 THEN '{"a": {"b": ' || turn || '}}' END AS found FROM conversations""")
def json_fence(spark, sf_dir):
    n, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    fenced = F.concat(F.lit('{x} then\n```json\n{"n": '), n, F.lit("}\n``` and {y}"))
    raw = F.concat(F.lit('said {"a": {"b": '), t, F.lit("}} done"))
    text = F.when(F.col("turn") % 3 == 0, fenced).when(F.col("turn") % 3 == 1, raw).otherwise("nothing")
    return fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", logs.reply_json(text).alias("found"))


# Lookups of names, lines and instructions


@query(
    "suffix_search",
    """WITH s AS (SELECT DISTINCT p_size AS scope, replace(p_name, ' ', '_') AS signal FROM part), a AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part),
       j AS (SELECT name, signal, scope, row_number() OVER (PARTITION BY name ORDER BY scope, signal) AS k FROM a JOIN s ON ends_with(signal, name) WHERE length(name) >= 4)
       SELECT name, signal, scope FROM j WHERE k = 1""",
)
def suffix_search(spark, sf_dir):
    part = fx.load(spark, sf_dir, "part")
    signals = part.select(F.col("p_size").alias("scope"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("signal")).distinct()
    return blocks.suffix_search(part.select(F.explode(F.split("p_name", " ")).alias("name")), signals)


@query("own_outputs", "SELECT DISTINCT l_orderkey AS bid, l_partkey AS text FROM lineitem EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1")
def own_outputs(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bid"), F.col("l_partkey").alias("text"), "l_linenumber")
    return blocks.without_own_outputs(rows, rows.where("l_linenumber = 1")).select("bid", "text").distinct()


@query(
    "buggy_line",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
       w AS (SELECT doc_id, trim(string_split(text, chr(10))[-1], ' ') AS t FROM documents) SELECT w.doc_id AS key, min(k)::BIGINT AS line FROM w LEFT JOIN l ON l.doc_id = w.doc_id AND trim(x, ' ') = t GROUP BY w.doc_id""",
)
def buggy_line(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("source"))
    wanted = docs.select("key", F.concat(F.lit("  "), F.element_at(F.split("source", "\n"), -1)).alias("text"))
    return blocks.first_line_of(wanted, docs).select("key", "line")


@query("instruction_at", "SELECT p.event_id, t.instruction FROM (SELECT event_id, user_id, event_id % 9 AS pc FROM events WHERE event_type = 'error') p LEFT JOIN (SELECT user_id, event_id % 7 AS pc, min_by(event_type, event_id) AS instruction FROM events GROUP BY 1, 2) t ON t.user_id = p.user_id AND t.pc = p.pc")
def instruction_at(spark, sf_dir):
    events = fx.load(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    trace = events.select("key", F.col("event_id").alias("at"), (F.col("event_id") % 7).alias("pc"), F.col("event_type").alias("instruction"))
    return blocks.instruction_at(events.where("event_type = 'error'").select("event_id", "key", (F.col("event_id") % 9).alias("pc")), trace).select("event_id", "instruction")


@query("early_stop", "SELECT l_orderkey AS bid, l_suppkey AS module FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def early_stop(spark, sf_dir):
    frontier = fx.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bid"), F.col("l_suppkey").alias("module"))
    ignored = fx.load(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("module"))
    return blocks.without_ignored(frontier, ignored, "module")


@query("constant_mutation", "SELECT p_partkey, '8''h' || CASE WHEN p_size = 0 THEN '01' ELSE lpad(lower(to_hex(floor(p_size * 0.5)::BIGINT)), 2, '0') END AS mutated FROM part")
def constant_mutation(spark, sf_dir):
    literal = F.concat(F.lit("8'h"), F.lpad(F.lower(F.hex("p_size")), 2, "0"))
    return fx.load(spark, sf_dir, "part").select("p_partkey", mutate.constant(literal, F.lit(0.5)).alias("mutated"))


@query("scope_weights", "SELECT p_brand AS scope, count(*) AS weight, sum(count(*)) OVER (ORDER BY p_brand ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, (SELECT count(*) FROM part) AS total FROM part GROUP BY p_brand")
def scope_weights(spark, sf_dir):
    return mutate.weighted_scopes(fx.load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("scope")).agg(F.count("*").alias("weight")))


@query("signal_picks", "SELECT user_id, event_type AS name, count(DISTINCT event_id % 4)::BIGINT AS n FROM events GROUP BY 1, 2")
def signal_picks(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), (F.col("event_id") % 4).alias("time"))
    chosen = rows.select("user_id", F.concat("name", F.lit("[0]")).alias("name"), (F.col("time") + F.when(F.col("time") == 3, 9).otherwise(0)).alias("time")).distinct()
    return evaluate.pick_signals(chosen.unionByName(rows.select("user_id", F.col("name"), F.lit(99).cast("bigint").alias("time")).distinct()), rows, ["user_id"]).groupBy("user_id", "name").agg(F.count("*").alias("n"))
