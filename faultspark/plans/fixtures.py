"""Domain tables as views of the shared tables, each with its SQL.

The shared tables hold no hardware designs, so tests, spectra, change logs,
graphs, blocks and coverage are derived from them, the same way in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tests(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id"), (F.col("o_orderstatus") == "F").alias("failed"))


def spectrum(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test_id"), (F.col("l_suppkey") % 10).alias("scope"), F.col("l_partkey").alias("line")).distinct()


def block_ranges(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("bid"), (F.col("p_partkey") % 10).alias("scope"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))


def changes(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("time"), "value")


def edges(spark, sf_dir):
    """Consecutive parts of an order, from the larger to the smaller key."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", F.lag("l_partkey").over(order).alias("was"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("dt"))
    return rows.where("was IS NOT NULL AND was <> l_partkey").select(F.greatest("l_partkey", "was").alias("dst"), F.least("l_partkey", "was").alias("src"), "dt").distinct()


def coverage(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    time = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    return rows.groupBy((F.col("l_suppkey") % 50).alias("scope"), F.col("l_linenumber").cast("bigint").alias("line"), time.alias("time")).agg((F.count("*") - 1).alias("count"))


def coverage_probes(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    time = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    return rows.select((F.col("l_suppkey") % 50).alias("scope"), (F.col("l_linenumber") + 1).cast("bigint").alias("line"), time.alias("time")).distinct()


def scopes(spark, sf_dir):
    """Paths region.nation.customer."""
    nation = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = load(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return customer.select("c_custkey", "n_nationkey", F.concat_ws(".", "r_name", "n_name", F.replace("c_name", F.lit("."), F.lit("_"))).alias("path"))


def predictions(spark, sf_dir):
    """Choices per bug (order): module, block, score; and the tie order."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bug_id"), F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("block_id"), F.col("l_extendedprice").alias("score"), "l_linenumber", "l_quantity")


def truth(spark, sf_dir):
    """The module and block of each bug: of the line of the largest quantity."""
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = load(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(order)).where("k = 1")
    return rows.select(F.col("l_orderkey").alias("bug_id"), F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("block_id"))


SQL = {
    "tests": "tests AS (SELECT o_orderkey AS test_id, o_orderstatus = 'F' AS failed FROM orders)",
    "spectrum": "spectrum AS (SELECT DISTINCT l_orderkey AS test_id, l_suppkey % 10 AS scope, l_partkey AS line FROM lineitem)",
    "counters": """hits AS (SELECT scope, line, count(*) FILTER (WHERE failed) AS a_ef, count(*) FILTER (WHERE NOT failed) AS a_ep
        FROM spectrum JOIN tests USING (test_id) GROUP BY scope, line),
      totals AS (SELECT count(*) FILTER (WHERE failed) AS f, count(*) FILTER (WHERE NOT failed) AS p FROM tests),
      counters AS (SELECT scope, line, a_ef, a_ep, f - a_ef AS a_nf, p - a_ep AS a_np FROM hits, totals)""",
    "doubles": "d AS (SELECT scope, line, a_ef::DOUBLE AS ef, a_ep::DOUBLE AS ep, a_nf::DOUBLE AS nf, a_np::DOUBLE AS np FROM counters)",
    "ranges": "ranges AS (SELECT p_partkey AS bid, p_partkey % 10 AS scope, p_partkey AS lo, p_partkey + p_size AS hi FROM part)",
    "edges": """steps AS (SELECT l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS was,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS dt FROM lineitem),
      edges AS (SELECT DISTINCT greatest(l_partkey, was) AS dst, least(l_partkey, was) AS src, dt FROM steps WHERE was IS NOT NULL AND was <> l_partkey)""",
    "coverage": """coverage AS (SELECT l_suppkey % 50 AS scope, l_linenumber::BIGINT AS line, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS time, count(*) - 1 AS n
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
      probes AS (SELECT DISTINCT l_suppkey % 50 AS scope, (l_linenumber + 1)::BIGINT AS line, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS time FROM lineitem)""",
    "scopes": """scopes AS (SELECT c_custkey, n_nationkey, r_name, n_name, replace(c_name, '.', '_') AS c, r_name || '.' || n_name || '.' || replace(c_name, '.', '_') AS path
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "truth": """truth AS (SELECT l_orderkey AS bug_id, l_suppkey AS module, l_partkey AS block_id FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1)""",
}


def with_sql(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + "\n"
