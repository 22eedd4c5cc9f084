import math

import pytest
from pyspark.sql import functions as F

from faultspark.functions import bits, names, rv64i, suspicion
from faultspark.operators import mutate, spectrum


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


@pytest.fixture(scope="module")
def counts(spark):
    cells = [[1, 0, 1, 0], [1, 1, 0, 1], [0, 1, 1, 0]]
    rows = [(t, 0, line) for t, row in enumerate(cells) for line, x in enumerate(row) if x]
    tests = spark.createDataFrame([(0, True), (1, False), (2, True)], "test_id int, failed boolean")
    return spectrum.counters(spark.createDataFrame(rows, "test_id int, scope int, line int"), tests)


def test_counters(counts):
    found = {r.line: (r.a_ef, r.a_ep, r.a_nf, r.a_np) for r in counts.collect()}
    assert found == {0: (1, 1, 1, 0), 1: (1, 1, 1, 0), 2: (2, 0, 0, 1), 3: (0, 1, 2, 0)}


@pytest.mark.parametrize(
    ("metric", "want"),
    [
        ("tarantula", [1 / 3, 1 / 3, 1, 0]),
        ("ochiai", [0.5, 0.5, 1, 0]),
        ("jaccard", [1 / 3, 1 / 3, 1, 0]),
        ("dstar", [0.5, 0.5, math.inf, 0]),
        ("gp19", [4 / 3, 4 / 3, 3, 0]),
        ("barinel", [0.5, 0.5, 0, 1]),
        ("crosstab", [0.288675, 0.288675, 0.577350, 0.816497]),
        ("zoltar", [1 / 10003, 1 / 10003, 1, 0]),
        ("ample", [0.5, 0.5, 1, 1]),
    ],
)
def test_metrics(counts, metric, want):
    got = [r.score for r in spectrum.scored(counts, metric).orderBy("line").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_metrics_without_runs(spark):
    zero = [F.lit(0.0)] * 4
    assert values(spark, *(f(*zero) for f in suspicion.METRICS.values())) == [0.0] * 9


def test_ranks(counts):
    ranked = {r.line: r.rank for r in spectrum.rank_in_scope(spectrum.scored(counts, "ochiai")).collect()}
    assert ranked == {2: 1, 0: 2, 1: 3, 3: 4}
    assert {r.line: r.rank for r in spectrum.rank_globally(spectrum.scored(counts, "ochiai")).collect()} == ranked


def test_sample_times(spark):
    got = values(spark, *(spectrum.sample_times(F.lit(t), F.lit(s), F.lit(i)) for t, s, i in [(10, 2, 2), (3, 5, 1), (0, 1, 1), (2, 0, 1)]))
    assert got == [[2, 6, 10], [3], [0], [2, 2, 2]]
    times = spark.createDataFrame([(0, 2), (0, 6), (0, 10)], "scope int, time int")
    assert [r.failed for r in spectrum.test_results(times).orderBy("test_id").collect()] == [True, True, False]
    assert [r.failed for r in spectrum.test_results(times, last_passes=False).orderBy("test_id").collect()] == [False, False, True]


def test_names(spark):
    lit = F.lit
    assert values(spark, names.parent_scope(lit("TOP.ex.alu")), names.parent_scope(lit("TOP")), names.signal_suffix(lit("io_redirect_target")), names.signal_suffix(lit("x"))) == ["TOP.ex", None, "redirect_target", "x"]
    assert values(spark, *(names.parse_numbers(lit(t)) for t in ("14,16-19,22", "16-19", "14", ""))) == [[14, 16, 17, 18, 19, 22], [16, 17, 18, 19], [14], []]
    assert values(spark, names.location_lines(lit("f,77:1,79:2")), names.location_lines(lit("f,1:2"))) == [[77, 78, 79], None]
    assert values(spark, *(names.canonical_port(lit(p)) for p in ("io_in_bits_redirect", "io_data", "io_out_pc", "target"))) == ["redirect", None, None, "target"]
    assert values(spark, *(names.is_constant(lit(t)) for t in ("RESET_0", "Reset", "12"))) == [True, False, True]
    assert values(spark, names.array_base(lit("mem[3]")), names.array_element(lit("mem"), lit(3)), names.suffixes(lit("a.b.c"))) == ["mem", "mem[3]", ["a.b.c", "b.c", "c"]]
    text = "ab\ncß\n"
    found = values(spark, *(names.position(lit(text), lit(k)) for k in (0, 2, 3, 5, 6, 7, 99)))
    assert [None if p is None else tuple(p) for p in found] == [(1, 1), (0, 2), (1, 2), (3, 2), (0, 3), None, None]
    spans = F.expr("array(struct(5L as offset, 2L as len), struct(0L as offset, 3L as len), struct(3L as offset, 1L as len))")
    assert [tuple(s) for s in values(spark, names.merge_spans(spans))[0]] == [(0, 4), (5, 2)]
    assert values(spark, names.name_distance(lit("abc"), lit("ABD")), names.name_distance(lit("Clk"), lit("CLK"))) == [3, 0]


def test_bits(spark):
    lit = F.lit
    assert values(spark, *(bits.state_class(lit(v)) for v in ("01", "0X1z", "01hW-", "q", ""))) == [0, 1, 2, None, None]
    assert values(spark, bits.state_code(lit("1")), bits.state_code(lit("Z")), bits.state_code(lit("?")), bits.render_states(F.array(lit(1), lit(0), lit(3)))) == [1, 3, None, "10z"]
    assert values(spark, *(bits.extend(lit(v), lit(4)) for v in ("1", "x1", "0101", "h"))) == ["0001", "xxx1", None, None]
    assert values(spark, bits.bit_slice(lit("10110001"), lit(5), lit(4)), bits.hex_value(lit(255), 4), bits.var_width(lit(3), lit(0))) == ["11", "0x00ff", 4]
    assert values(spark, *(bits.vcd_id(lit(c)) for c in ("!", '"', "!!", "", "a b"))) == [0, 1, 94, None, None]
    assert [tuple(v) for v in values(spark, *(bits.vcd_name(lit(n)) for n in ("a[3:0]", "a[3]", "a")))] == [("a", 3, 0), ("a", 3, 3), ("a", None, None)]


@pytest.mark.parametrize(
    ("word", "want"),
    [
        (0x00008067, ("jalr", "zero, 0(ra)")),
        (0xFFF00093, ("addi", "ra, zero, -1")),
        (0x00A50533, ("add", "a0, a0, a0")),
        (0xFE0418E3, ("bne", "s0, zero, -16")),
        (0x0000006F, ("jal", "zero, 0")),
        (0x12345537, ("lui", "a0, 0x12345")),
        (0x00B53423, ("sd", "a1, 8(a0)")),
        (0x00000073, ("ecall", "")),
        (0x30200073, ("mret", "0x302")),
        (0x34051073, ("csrrw", "zero, 0x340, a0")),
        (0x0000000F, ("fence", "")),
        (0xFFFFFFFF, ("unknown", "0xffffffff")),
    ],
)
def test_decode(spark, word, want):
    assert tuple(values(spark, rv64i.decode(F.lit(word)))[0]) == want


def test_mutation(spark):
    lit = F.lit
    assert values(spark, *(mutate.mutated(lit(o)) for o in ("&&", "<=", "^"))) == ["||", ">=", None]
    assert values(spark, mutate.spliced(lit("a + b"), lit(2), lit(1), lit("-"))) == ["a - b"]
    assert values(spark, *(mutate.constant(lit(c), lit(0.5)) for c in ("4'b1010", "8'hff", "12", "1'b0", "x"))) == ["4'b0101", "8'h7f", "06", "1'b1", None]
    near = mutate.nearest_names(spark.createDataFrame([("clk",), ("clk2",), ("reset",)], "name string"))
    assert {r.name: (r.other, r.distance) for r in near.collect()}["clk"] == ("clk2", 1)
    weights = mutate.weighted_scopes(spark.createDataFrame([("a", 2), ("b", 3)], "scope string, weight int"))
    assert [(r.upto, r.total) for r in weights.orderBy("scope").collect()] == [(2, 5), (5, 5)]
