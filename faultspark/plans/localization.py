"""Queries of spectrum localization, coverage, blocks and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultspark.functions import names, suspicion
from faultspark.operators import blocks, coverage, slicing, spectrum
from faultspark.plans import fixtures as fx
from faultspark.plans.registry import query

COUNTERS = fx.with_sql("tests", "spectrum", "counters")
DOUBLES = fx.with_sql("tests", "spectrum", "counters", "doubles")

METRIC_SQL = {
    "tarantula": "CASE WHEN fr + pr > 0 THEN fr / (fr + pr) ELSE 0 END",
    "ochiai": "CASE WHEN sqrt((ef + nf) * (ef + ep)) > 0 THEN ef / sqrt((ef + nf) * (ef + ep)) ELSE 0 END",
    "jaccard": "CASE WHEN ef + nf + ep > 0 THEN ef / (ef + nf + ep) ELSE 0 END",
    "dstar": "CASE WHEN ep + nf > 0 THEN ef * ef / (ep + nf) WHEN ef > 0 THEN 'inf'::DOUBLE ELSE 0 END",
    "gp19": "CASE WHEN ef + nf > 0 AND 2.0 * ep + ef > 0 THEN ef * (1 + 1 / (2.0 * ep + ef)) ELSE 0 END",
    "barinel": "CASE WHEN ef + ep > 0 THEN 1 - ef / greatest(ef + nf, 1) ELSE 0 END",
    "crosstab": "CASE WHEN ex > 0 THEN abs(ef - ex) / sqrt(ex) ELSE 0 END",
    "zoltar": "CASE WHEN ef > 0 THEN ef / (ef + nf + ep + 10000.0::DOUBLE * nf * ep / ef) ELSE 0 END",
    "ample": "CASE WHEN ef + nf > 0 AND ep + np > 0 THEN abs(ef / (ef + nf) - ep / (ep + np)) WHEN ef + nf > 0 THEN ef / (ef + nf) ELSE 0 END",
}
SCORED = (
    DOUBLES + ", x AS (SELECT *, CASE WHEN ef + nf > 0 THEN ef / (ef + nf) ELSE 0 END AS fr, CASE WHEN ep + np > 0 THEN ep / (ep + np) ELSE 0 END AS pr, "
    "CASE WHEN ef + ep + nf + np > 0 THEN (ef + ep) * (ef + nf) / (ef + ep + nf + np) ELSE 0 END AS ex FROM d), scored AS (SELECT scope, line, ({score})::DOUBLE AS score FROM x)\n"
)
OCHIAI = SCORED.format(score=METRIC_SQL["ochiai"])


def _counts(spark, sf_dir):
    return spectrum.counters(fx.spectrum(spark, sf_dir), fx.tests(spark, sf_dir))


@query("sbfl_counters", COUNTERS + "SELECT * FROM counters")
def sbfl_counters(spark, sf_dir):
    return _counts(spark, sf_dir)


for _metric in suspicion.METRICS:
    query(f"sbfl_{_metric}", SCORED.format(score=METRIC_SQL[_metric]) + "SELECT * FROM scored")(lambda spark, sf_dir, m=_metric: spectrum.scored(_counts(spark, sf_dir), m))


@query("sbfl_rank_scope", OCHIAI + "SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, line) AS rank FROM scored")
def sbfl_rank_scope(spark, sf_dir):
    return spectrum.rank_in_scope(spectrum.scored(_counts(spark, sf_dir), "ochiai"))


@query("sbfl_rank_global", OCHIAI + "SELECT *, row_number() OVER (ORDER BY score DESC, scope, line) AS rank FROM scored")
def sbfl_rank_global(spark, sf_dir):
    return spectrum.rank_globally(spectrum.scored(_counts(spark, sf_dir), "ochiai"))


@query("sbfl_topk", OCHIAI + "SELECT * FROM scored ORDER BY score DESC, scope, line LIMIT 20")
def sbfl_topk(spark, sf_dir):
    return spectrum.top(spectrum.scored(_counts(spark, sf_dir), "ochiai"), 20)


@query(
    "sbfl_line_to_block",
    OCHIAI + ", " + fx.SQL["ranges"] + " SELECT scope, line, score, min(bid) AS bid FROM scored JOIN ranges USING (scope) WHERE line BETWEEN lo AND hi GROUP BY ALL",
)
def sbfl_line_to_block(spark, sf_dir):
    return spectrum.lines_to_blocks(spectrum.scored(_counts(spark, sf_dir), "ochiai"), fx.block_ranges(spark, sf_dir))


@query(
    "sbfl_localize",
    OCHIAI + ", " + fx.SQL["ranges"] + " SELECT scope, line, score, min(bid) AS bid FROM scored JOIN ranges USING (scope) WHERE line BETWEEN lo AND hi GROUP BY ALL ORDER BY score DESC, scope, line LIMIT 10",
)
def sbfl_localize(spark, sf_dir):
    return spectrum.localize(fx.spectrum(spark, sf_dir), fx.tests(spark, sf_dir), fx.block_ranges(spark, sf_dir))


@query(
    "sample_times",
    """SELECT event_id, t - s * i AS sample FROM (SELECT event_id, event_id % 50 AS t, (1 + event_id % 3) * (1 + event_id % 4) AS s FROM events),
       LATERAL (SELECT unnest(generate_series(0, t // s)) AS i) WHERE t - s * i >= 0""",
)
def sample_times(spark, sf_dir):
    e = F.col("event_id")
    times = spectrum.sample_times(e % 50, 1 + e % 3, 1 + e % 4)
    return fx.load(spark, sf_dir, "events").select("event_id", F.explode(times).alias("sample"))


@query("block_bounds", "SELECT l_suppkey AS bid, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1")
def block_bounds(spark, sf_dir):
    return spectrum.block_bounds(fx.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bid"), F.col("l_partkey").alias("line")))


@query("scope_max_line", "SELECT l_suppkey % 10 AS scope, max(l_partkey) AS max_line FROM lineitem GROUP BY 1")
def scope_max_line(spark, sf_dir):
    return spectrum.max_line(fx.spectrum(spark, sf_dir))


# Coverage

COVERAGE = fx.with_sql("coverage")
LOOKED = """, exact AS (SELECT scope, line, time, max(n) AS n FROM coverage GROUP BY ALL),
  top AS (SELECT scope, time, max(n) AS n FROM coverage WHERE n > 0 GROUP BY ALL),
  looked AS (SELECT scope, line, time, coalesce(e.n, t.n) AS n FROM probes LEFT JOIN exact e USING (scope, line, time) LEFT JOIN top t USING (scope, time))"""


@query("coverage_lookup", COVERAGE + LOOKED + " SELECT scope, line, time, n AS count FROM looked")
def coverage_lookup(spark, sf_dir):
    return coverage.lookup(fx.coverage_probes(spark, sf_dir), fx.coverage(spark, sf_dir))


@query(
    "coverage_three_valued",
    COVERAGE + LOOKED + """, typed AS (SELECT *, CASE (scope + line) % 4 WHEN 0 THEN 'AlwaysComb' WHEN 1 THEN 'Assign' WHEN 2 THEN 'ModuleInput' END AS btype FROM looked),
      dead AS (SELECT DISTINCT scope, line FROM coverage WHERE n = 0)
      SELECT scope, line, time, btype, CASE WHEN btype LIKE 'Always%' THEN n WHEN btype = 'Assign' THEN CASE WHEN d.scope IS NULL THEN 1 ELSE 0 END WHEN btype IS NOT NULL THEN 1 END AS count
      FROM typed LEFT JOIN dead d USING (scope, line)""",
)
def coverage_three_valued(spark, sf_dir):
    kind = (F.col("scope") + F.col("line")) % 4
    probes = fx.coverage_probes(spark, sf_dir).withColumn("btype", F.when(kind == 0, "AlwaysComb").when(kind == 1, "Assign").when(kind == 2, "ModuleInput"))
    found = fx.coverage(spark, sf_dir)
    return coverage.three_valued(probes, found, found.where("count = 0").select("scope", "line").distinct())


@query(
    "coverage_comb_fallback",
    COVERAGE + """, seq AS (SELECT *, 'seq' AS kind FROM coverage), comb AS (SELECT * FROM seq WHERE kind = 'comb'),
      used AS (SELECT * FROM comb UNION ALL SELECT * FROM seq WHERE NOT EXISTS (SELECT 1 FROM comb)) SELECT scope, sum(n)::BIGINT AS count FROM used GROUP BY scope""",
)
def coverage_comb_fallback(spark, sf_dir):
    found = fx.coverage(spark, sf_dir).withColumn("kind", F.lit("seq"))
    return coverage.comb_or_seq(found).groupBy("scope").agg(F.sum("count").alias("count"))


@query(
    "dead_assign_filter",
    COVERAGE + """, alive AS (SELECT DISTINCT scope, line FROM coverage WHERE n > 0), mods AS (SELECT DISTINCT scope FROM coverage),
      b AS (SELECT p_partkey AS bid, p_partkey % 60 AS scope, CASE p_size % 3 WHEN 0 THEN 'Assign' WHEN 1 THEN 'AlwaysSeq' ELSE 'ModuleOutput' END AS btype, unnest([1 + p_size % 7, 1 + p_size % 5])::BIGINT AS line FROM part)
      SELECT DISTINCT bid, btype FROM b WHERE btype <> 'Assign' OR scope NOT IN (SELECT scope FROM mods) OR EXISTS (SELECT 1 FROM b c JOIN alive a ON a.scope = c.scope AND a.line = c.line WHERE c.bid = b.bid)""",
)
def dead_assign_filter(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "Assign").when(size % 3 == 1, "AlwaysSeq").otherwise("ModuleOutput")
    rows = fx.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("bid"), (F.col("p_partkey") % 60).alias("scope"), kind.alias("btype"), F.explode(F.array((1 + size % 7).cast("bigint"), (1 + size % 5).cast("bigint"))).alias("line"))
    return coverage.live_blocks(rows, fx.coverage(spark, sf_dir)).select("bid", "btype").distinct()


@query(
    "coverage_scope_fallback",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'cpu.soc.core.' ELSE '' END || 'cpu.soc.core.' || event_type AS path FROM events)
       SELECT event_id, CASE WHEN event_id % 2 = 0 THEN substring(path, 14) ELSE path END AS path FROM s""",
)
def coverage_scope_fallback(spark, sf_dir):
    twice = F.when(F.col("event_id") % 2 == 0, "cpu.soc.core.").otherwise("")
    rows = fx.load(spark, sf_dir, "events").select("event_id", F.concat(twice, F.lit("cpu.soc.core."), F.col("event_type")).alias("path"))
    return rows.withColumn("path", coverage.single_scope(F.col("path"), "cpu.soc.core."))


# Blocks


@query("blocks_ports", "SELECT p_partkey AS bid, CASE p_size % 3 WHEN 0 THEN 'ModuleInput' ELSE 'ModuleOutput' END AS btype FROM part WHERE p_size % 3 < 2")
def blocks_ports(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "ModuleInput").when(F.col("p_size") % 3 == 1, "ModuleOutput").otherwise("Assign")
    return blocks.ports(fx.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("bid"), kind.alias("btype")))


@query(
    "blocks_descendants",
    fx.with_sql("scopes") + ", tops AS (SELECT DISTINCT r_name || '.' || n_name AS top FROM scopes) SELECT top, count(*) AS below FROM tops JOIN scopes ON starts_with(path, top) AND length(path) > length(top) GROUP BY top",
)
def blocks_descendants(spark, sf_dir):
    paths = fx.scopes(spark, sf_dir).select("path")
    tops = paths.select(names.parent_scope(F.col("path")).alias("top")).distinct()
    return blocks.descendants(tops, paths).groupBy("top").agg(F.count("*").alias("below"))


@query("block_by_line", fx.with_sql("ranges") + "SELECT line, min(bid) AS bid FROM (SELECT DISTINCT l_partkey AS line FROM lineitem) JOIN ranges ON line BETWEEN lo AND hi AND scope = line % 10 GROUP BY line")
def block_by_line(spark, sf_dir):
    lines = fx.load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).alias("scope"), F.col("l_partkey").alias("line")).distinct()
    return spectrum.lines_to_blocks(lines, fx.block_ranges(spark, sf_dir)).select("line", "bid")


@query(
    "block_by_range",
    """WITH b AS (SELECT p_partkey AS bid, p_partkey * 20 AS a0, 10 + p_size AS len FROM part), p AS (SELECT DISTINCT l_orderkey * 7 % 40000 AS place FROM lineitem)
       SELECT place, min(bid) AS bid FROM p JOIN b ON place >= a0 AND place < a0 + len GROUP BY place HAVING count(*) = 1""",
)
def block_by_range(spark, sf_dir):
    ranges = fx.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("bid"), (F.col("p_partkey") * 20).alias("at"), (10 + F.col("p_size")).alias("len"))
    places = fx.load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7 % 40000).alias("place")).distinct()
    return blocks.by_offset(places, ranges, 64)


@query(
    "driven_block",
    "SELECT l_partkey % 50 AS signal, l_suppkey % 10 AS scope, min(l_orderkey) AS bid FROM lineitem GROUP BY 1, 2",
)
def driven_block(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("signal"), (F.col("l_suppkey") % 10).alias("scope"), F.col("l_orderkey").alias("bid"))
    return blocks.first_driver(rows)


HEAVY = """, pairs AS (SELECT l_partkey AS a, lead(l_partkey) OVER w AS b, l_quantity AS q, lead(l_quantity) OVER w AS r FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
  links AS (SELECT DISTINCT a, b FROM pairs WHERE q >= 49 AND r >= 49 AND a <> b), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  walk AS (SELECT a AS node, a AS seen FROM ways UNION SELECT w.node, x.b FROM walk w JOIN ways x ON x.a = w.seen)"""


@query("block_merge_components", "WITH RECURSIVE " + HEAVY[2:] + " SELECT node, min(seen) AS label FROM walk GROUP BY node")
def block_merge_components(spark, sf_dir):
    return slicing.merge_components(blocks.heavy_pairs(fx.load(spark, sf_dir, "lineitem"), 49))


@query("block_merge_components_all")
def block_merge_components_all(spark, sf_dir):
    """All links, whatever their quantity; no SQL, as the recursive walk of all pairs is too slow."""
    return slicing.merge_components(blocks.heavy_pairs(fx.load(spark, sf_dir, "lineitem"), 0))


# Slices

EDGES = fx.with_sql("edges")


@query("slice_static", EDGES + ", walk AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 500 = 7 UNION SELECT src FROM walk JOIN edges ON dst = node) SELECT node FROM walk")
def slice_static(spark, sf_dir):
    start = fx.load(spark, sf_dir, "part").where("p_partkey % 500 = 7").select(F.col("p_partkey").alias("node"))
    return slicing.reach(fx.edges(spark, sf_dir), start, timed=False).select("node")


@query("slice_timed", EDGES + ", walk AS (SELECT p_partkey AS node, 4 AS time FROM part WHERE p_partkey % 500 = 7 UNION SELECT src, time - dt FROM walk JOIN edges ON dst = node WHERE time - dt >= 2) SELECT node, time::BIGINT AS time FROM walk")
def slice_timed(spark, sf_dir):
    start = fx.load(spark, sf_dir, "part").where("p_partkey % 500 = 7").select(F.col("p_partkey").alias("node"), F.lit(4).cast("bigint").alias("time"))
    return slicing.reach(fx.edges(spark, sf_dir), start, bound=2).select("node", "time")


@query("slice_scope_limited", EDGES + ", walk AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 500 = 8 UNION SELECT src FROM walk JOIN edges ON dst = node WHERE src % 2 = 0) SELECT node FROM walk")
def slice_scope_limited(spark, sf_dir):
    start = fx.load(spark, sf_dir, "part").where("p_partkey % 500 = 8").select(F.col("p_partkey").alias("node"))
    return slicing.reach(fx.edges(spark, sf_dir), start, timed=False, scope=F.col("node") % 2 == 0).select("node")


def _all_starts(spark, sf_dir):
    return fx.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


@query("slice_static_all")
def slice_static_all(spark, sf_dir):
    return slicing.reach(fx.edges(spark, sf_dir), _all_starts(spark, sf_dir), timed=False).select("node")


@query("slice_timed_all")
def slice_timed_all(spark, sf_dir):
    """From all parts at time 4, down to time 0."""
    start = _all_starts(spark, sf_dir).withColumn("time", F.lit(4).cast("bigint"))
    return slicing.reach(fx.edges(spark, sf_dir), start, bound=0).select("node", "time")


@query("slice_scope_limited_all")
def slice_scope_limited_all(spark, sf_dir):
    return slicing.reach(fx.edges(spark, sf_dir), _all_starts(spark, sf_dir), timed=False, scope=F.col("node") % 2 == 0).select("node")


@query(
    "slice_limit",
    EDGES + """, walk AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey % 500 = 7 UNION SELECT src, level + 1 FROM walk JOIN edges ON dst = node WHERE level < 4)
      SELECT node, min(level) AS level FROM walk GROUP BY node ORDER BY level, node LIMIT 101""",
)
def slice_limit(spark, sf_dir):
    start = fx.load(spark, sf_dir, "part").where("p_partkey % 500 = 7").select(F.col("p_partkey").alias("node"))
    return slicing.reach(fx.edges(spark, sf_dir), start, timed=False, limit=100)


@query("slice_dynamic")
def slice_dynamic(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey")
    key = lambda c: F.concat(F.lit("s"), (F.col(c) % 997).cast("string"))
    flow = rows.select(F.col("l_partkey").alias("bid"), F.lit("top").alias("scope"), (F.col("l_returnflag") == "R").alias("seq"), F.col("l_linenumber").alias("line"), key("l_partkey").alias("out"), key("l_suppkey").alias("src")).distinct()
    cover = rows.select(F.lit("top").alias("scope"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") % 6).cast("bigint").alias("time"), F.lit(1).alias("count")).distinct()
    start = spark.createDataFrame([("top", "s7", 5)], "scope string, signal string, time bigint")
    return slicing.dynamic_slice(flow, cover, start)


@query(
    "frontier_fallback",
    fx.with_sql("scopes") + """, known AS (SELECT DISTINCT r_name AS k FROM scopes UNION SELECT DISTINCT r_name || '.' || n_name FROM scopes WHERE n_nationkey % 2 = 0)
      SELECT path, max_by(k, length(k)) AS scope FROM scopes LEFT JOIN known ON path = k OR starts_with(path, k || '.') GROUP BY path""",
)
def frontier_fallback(spark, sf_dir):
    paths = fx.scopes(spark, sf_dir)
    nations = paths.withColumn("path", names.parent_scope(F.col("path")))
    regions = nations.select(names.parent_scope(F.col("path")).alias("path"))
    return slicing.resolve_scope(paths, regions.union(nations.where("n_nationkey % 2 = 0").select("path")).distinct())
