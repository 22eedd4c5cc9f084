import random

import pytest
from pyspark.sql import functions as F

from faultspark import api
from faultspark.operators import blocks, coverage, evaluate, mutate, navigate, slicing, wave
from faultspark.sources import designs, logs, rtl, vcd
from faultspark.streaming import held


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_as_of_equals_brute_force(spark):
    rng = random.Random(1)
    changes = [("s%d" % rng.randrange(3), rng.randrange(20), k, rng.choice([None, 1, 2, 3])) for k in range(60)]
    probes = [(k, "s%d" % rng.randrange(4), rng.randrange(22)) for k in range(50)]
    out = wave.as_of(spark.createDataFrame(probes, "probe_id int, signal string, time int"), spark.createDataFrame(changes, "signal string, time int, seq int, value int"), ["signal"])
    got = {r.probe_id: r.found for r in out.collect()}
    for k, s, t in probes:
        held_at = sorted((c[1], -c[2], c[3]) for c in changes if c[0] == s and c[1] <= t)
        assert got[k] == (held_at[-1][2] if held_at else None)


def test_change_logs(spark):
    log = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 1, 1), ("a", 2, 2, 2), ("a", 2, 3, 5), ("a", 1, 4, 7), ("b", 0, 5, None), ("b", 3, 6, None)], "signal string, time int, seq int, value int")
    assert rows(wave.compact(log, ["signal"], ["seq"]).select("seq"), "seq") == [(0,), (2,), (3,), (4,), (5,)]
    assert (2, 2, 2) in rows(wave.delta_groups(log, ["signal"]).select("time", "elements", "first_value"), "time")
    assert rows(wave.monotonic(log, ["signal"], ["seq"]).select("seq"), "seq") == [(0,), (1,), (2,), (3,), (5,), (6,)]
    assert rows(wave.probe_start(log, ["signal"], trivial=(1,)), "signal") == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError, match="overlap"):
        wave.concat_in_order([log, log], ["signal"])
    scopes = spark.createDataFrame([(1, None, "top"), (2, 1, "u"), (3, 2, "v")], "scope_id int, parent_id int, name string")
    assert rows(wave.flatten_scopes(scopes), "scope_id") == [(1, "top"), (2, "top.u"), (3, "top.u.v")]
    values = spark.createDataFrame([(1, 0, "10110001")], "signal_id int, time int, value string")
    alias = spark.createDataFrame([(9, 1, 5, 4)], "signal_id int, source_id int, msb int, lsb int")
    assert rows(wave.resolve_slices(values, alias), "signal_id") == [(9, 0, "11")]
    assert wave.markdown([{"time": 1, "a": 2}]) == "| time | a |\n| --- | --- |\n| 1 | 2 |" and wave.markdown([]) == ""


def test_static_slice_holds_dynamic_slice(spark):
    rng = random.Random(7)
    flow = [(rng.randrange(30), "top", rng.random() < 0.4, rng.randrange(5), f"s{rng.randrange(12)}", f"s{rng.randrange(12)}") for _ in range(60)]
    seqs = {f[0]: f[2] for f in flow}
    flow = sorted({(b, s, seqs[b], line, o, i) for b, s, _, line, o, i in flow})
    covered = sorted({("top", rng.randrange(5), t, 1) for t in range(6) for _ in range(3)})
    table = spark.createDataFrame(flow, "bid int, scope string, seq boolean, line int, out string, src string")
    start = spark.createDataFrame([("top", "s0", 5)], "scope string, signal string, time bigint")
    cover = spark.createDataFrame(covered, "scope string, line int, time bigint, count int")
    got = {(r.bid, r.time): r.level for r in slicing.dynamic_slice(table, cover, start).collect()}
    assert slicing.dynamic_slice(table, cover, start.limit(0)).schema.simpleString() == "struct<bid:int,time:bigint,level:int>"
    live = {(line, t) for _, line, t, _ in covered}
    frontier, asked, done, want, level = {("s0", 5)}, {("s0", 5)}, set(), {}, 0
    while frontier:
        hit = [(b, line, o, t, q) for o, t in frontier for b, _, q, line, o2, _ in flow if o2 == o and (line, t) in live]
        for b, _, _, t, _ in hit:
            want.setdefault((b, t), level)
        fresh = {}
        for b, line, o, t, q in hit:
            if (b, line, o) not in done:
                fresh[b, line, o, q] = max(t, fresh.get((b, line, o, q), -1))
        done |= {k[:3] for k in fresh}
        step = {(i, t - (1 if q else 0)) for (b, line, o, q), t in fresh.items() for b2, _, _, l2, o2, i in flow if (b2, l2, o2) == (b, line, o)}
        frontier = {x for x in step if x[1] >= 0} - asked
        asked |= frontier
        level += 1
    assert got == want
    edges = table.select(F.col("out").alias("dst"), F.col("src"), F.lit(0).alias("dt"))
    reach = {r.node for r in slicing.reach(edges, spark.createDataFrame([("s0",)], "node string"), timed=False).collect()}
    assert {b for b, _ in got} <= {f[0] for f in flow if f[4] in reach}


def test_timed_reach(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 0), (3, 1, 1), (3, 4, 5)], "dst int, src int, dt int")
    start = spark.createDataFrame([(1, 3)], "node int, time int")
    assert rows(slicing.reach(edges, start), "time", "node") == [(2, 0, 4), (3, 0, 5), (1, 1, 3), (2, 2, 1), (3, 2, 2), (1, 3, 0)]
    assert rows(slicing.reach(edges, start, limit=2), "level") == [(1, 3, 0), (2, 2, 1), (3, 2, 2)]
    assert rows(slicing.reach(edges, start, scope=F.col("node") != 3), "level") == [(1, 3, 0), (2, 2, 1)]
    assert rows(slicing.reach(edges, start, timed=False).select("node"), "node") == [(1,), (2,), (3,), (4,)]
    circle = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0), (3, 1, 0)], "dst int, src int, dt int")
    timeless = spark.createDataFrame([(1, None), (1, None)], "node int, time int")
    assert rows(slicing.reach(circle, timeless), "level") == [(1, None, 0), (2, None, 1), (3, None, 2)]
    assert slicing.reach(circle, timeless.limit(0)).count() == 0


def test_wide_constants_and_repeated_commits(spark):
    wide = "128'hffffffffffffffffffffffffffffffff"
    table = spark.createDataFrame([(wide,), ("128'h0",), ("8'b00000011",), ("99999999999999999999999",), ("64'hFFFF",)], "c string")
    out = [r.m for r in table.select(mutate.constant(F.col("c"), F.lit(0.5)).alias("m")).collect()]
    assert out == ["128'h7fffffffffff" + "f" * 20, "128'h1", "8'b00000001", "49999999999999999999999"[:15] + "99999999", "64'h7fff"]
    line = "[%d] commit pc 80000000 inst 00000013 wen 1 dst %d data 10"
    log = "\n".join(line % (i, k) for k, i in enumerate([5, 3, 5, 9, 3, 1]))
    got = spark.createDataFrame([(log,), ("",), (None,)], "log string").select(logs.commits(F.col("log")).alias("c")).collect()
    assert [(c.idx, c.dst) for c in got[0].c] == [(5, 0), (3, 1), (9, 3), (1, 5)] and got[1].c == [] and got[2].c is None



def test_scopes_and_drivers(spark):
    outputs = spark.createDataFrame([("t", "a", 1, "Assign"), ("t.u", "b", 2, "ModuleOutput"), ("t.u", "a", 3, "ModuleOutput")], "scope string, text string, bid int, btype string")
    frontier = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "scope string, text string")
    below = spark.createDataFrame([("t", "t.u")], "scope string, below string")
    assert rows(slicing.driving_blocks(frontier, outputs, below).select("text", "bid"), "bid") == [("a", 1), ("b", 2)]
    paths = spark.createDataFrame([("x.alu",), ("x.alu2",), ("x.alu.y",)], "path string")
    tops = spark.createDataFrame([("x.alu",)], "top string")
    assert rows(blocks.descendants(tops, paths).select("path"), "path") == [("x.alu.y",), ("x.alu2",)]
    assert rows(blocks.descendants(tops, paths, strict=True).select("path"), "path") == [("x.alu.y",)]
    merged = blocks.merge(
        spark.createDataFrame([(1, ["a"], ["b"], "x"), (2, ["b"], ["c"], "y"), (3, ["q"], ["r"], "z")], "bid int, inputs array<string>, outputs array<string>, ctx string"),
        slicing.merge_components(spark.createDataFrame([(1, 2)], "a int, b int")),
    )
    assert rows(merged, "bid") == [(1, ["a", "b"], ["b", "c"], ["x", "y"]), (3, ["q"], ["r"], ["z"])]
    ports = spark.createDataFrame([("t", "io_a_x"), ("t", "clk")], "scope string, port string")
    wired = spark.createDataFrame([("t", "clk", "clock"), ("t", "in_a_x", "s")], "scope string, port string, signal string")
    assert rows(blocks.bind_ports(ports, wired), "port") == [("t", "clk", "clock"), ("t", "io_a_x", "s")]


def test_coverage(spark):
    cover = spark.createDataFrame([("s", 1, 5, 0), ("s", 2, 5, 4)], "scope string, line int, time int, count bigint")
    probes = spark.createDataFrame([("s", 1, 5), ("s", 9, 5), ("s", 1, 6)], "scope string, line int, time int")
    assert rows(coverage.lookup(probes, cover), "time", "line") == [("s", 1, 5, 0), ("s", 9, 5, 4), ("s", 1, 6, None)]
    assert coverage.plain(probes).where("count = 1").count() == 3
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    assert coverage.covered_files(files, files.limit(0)).count() == 2 and coverage.covered_files(files, files.where("file = 'a'")).count() == 1


LOG = """[00] commit pc 0000000080000000 inst 00000413 wen 1 dst 08 data 0000000000000000 idx 000
[01] commit pc 000000008000000c inst 00008067 wen 0 dst 00 data 0000000080000010 idx 001
[00] commit pc 0000000080000000 inst 00000413 wen 1 dst 08 data 0000000000000000 idx 000
\x1b[31mABORT at pc = 0x80000012\x1b[0m
Core-0 instrCnt = 4, cycleCnt = 1,536, IPC = 0.002
Guest cycle spent: 1,537 (this will be different)
"""


def test_logs(spark):
    report = spark.createDataFrame([(LOG,)], "log string").select(logs.emulator_report(F.col("log")).alias("r")).first().r
    assert (int(report.abort_pc), report.instr_cnt, report.cycle_cnt, report.guest_cycle) == (0x80000012, 4, 1536, 1537)
    assert [c.idx for c in report.commits] == [0, 1] and int(report.dut_pc) == 0x80000012 and int(report.ref_pc) == 0x80000010
    lines = ["FAILURE: Co-simulation mismatch at time                   22", "PC mismatch, DUT retired : f6148 , but the ISS retired: 109fb8", "nothing"]
    table = spark.createDataFrame([("0", k, x) for k, x in enumerate(lines)], "bug_id string, at int, line string")
    told = logs.mismatch_report(table, ["bug_id"], "at").first()
    assert (told.kind, int(told.dut), int(told.oracle), told.failure_time) == ("Pc", 0xF6148, 0x109FB8, 22)
    trace = ["core 0: 0x00100080 (0x7390906f) j pc + 0x9f38", "20 6 00100080 7390906f jal x0,f6148  x0=0", "20 6 00100084 00008067 ret", "junk"]
    found = spark.createDataFrame([("0", k, x) for k, x in enumerate(trace)], "bug_id string, at int, line string")
    assert [(r.back, r.instruction) for r in logs.trace_context(found, ["bug_id"], "at").orderBy("back").collect()] == [(1, "ret"), (2, "jal x0,f6148"), (3, "j pc + 0x9f38")]
    made = api.test_report(table, found, 2).first()
    assert (made.start_time, made.time_bound) == (19, 11) and "jal x0,f6148" in made.test_info and "0x000f6148" in made.test_info
    signals = spark.createDataFrame([("pc",), ("x5",), ("ra",), ("mcause",), (None,)], "f string").select(logs.start_signal(F.col("f")).alias("s")).collect()
    assert [r.s for r in signals] == ["io_redirect_target", "io_out_bits", "io_out_bits", "io_redirect_target", "io_redirect_target"]


def test_coverage_files(spark, tmp_path):
    line = "C '\x01f\x02alu.sv\x01l\x027\x01t\x02line\x01h\x02TOP.u\x01S\x027,9-10' 3"
    (tmp_path / "coverage_17_comb.dat").write_text(f"# header\n{line}\nC 'broken 5\n")
    (tmp_path / "coverage_18.dat").write_text(line + "\n")
    got = rows(logs.read_coverage(spark, f"{tmp_path}/*.dat").drop("file"), "line")
    assert got == [("TOP.u", "comb", 17, 7, 3), ("TOP.u", "comb", 17, 9, 3), ("TOP.u", "comb", 17, 10, 3)]


SV = """// a design
module alu #(parameter W = 8) (input logic clk, input [W-1:0] a, b, output logic [W-1:0] y, output z);
  wire [W-1:0] sum = a + b, other;
  logic [W-1:0] r;
  assign z = r == 8'h0;
  always_ff @(posedge clk) begin
    if (a[0]) r <= sum;
    else case (b) 1: r <= a; default: r <= '0; endcase
  end
  always_comb y = r;
endmodule
"""
TOP = """module top(input clk, output z);
  logic [7:0] p, q, o;
  generate if (1) begin : g
    alu #(.W(8)) u (.clk, .a(p), .b(q[7:0]), .y(o), .z(z));
  end endgenerate
endmodule
"""


def test_rtl(spark, tmp_path):
    (tmp_path / "alu.sv").write_text(SV)
    (tmp_path / "top.v").write_text(TOP)
    (tmp_path / "bad.sv").write_text("module broken(")
    (tmp_path / "note.txt").write_text("module no; endmodule")
    table = rtl.read_rtl(spark, str(tmp_path)).cache()
    assert {r.module for r in table.select("module").distinct().collect()} == {"alu", "top"}
    scopes = rtl.elaborate(table, "top")
    assert rows(scopes, "level") == [("top", "top", 0), ("top.g.u", "alu", 1)]
    found = rtl.scope_blocks(table, scopes)
    assert [r.btype for r in found.where("scope = 'top.g.u'").orderBy("bid").collect()] == ["ModuleInput"] * 3 + ["ModuleOutput"] * 2 + ["Assign", "Assign", "AlwaysSeq", "AlwaysComb"]
    flow = {(r.out, r.src, r.seq) for r in rtl.scope_flow(table, found).collect()}
    assert {("sum", "a", False), ("z", "r", False), ("r", "sum", True), ("r", "b", True), ("y", "r", False)} <= flow
    assert ("top.g.u", "b", "q") in {(r.child_scope, r.port, r.signal) for r in rtl.port_map(table, scopes).collect()}
    cover = spark.createDataFrame([("top.g.u", line, t, 1) for line in range(1, 12) for t in range(6)], "scope string, line int, time bigint, count int")
    assert len(api.localize(table, "top", cover, "y", 4, scope="top.g.u")) >= 2
    assert designs.block_sizes(found).where("btype = '{\"Always\":\"SEQ\"}'").first().block_size == 4


VCD = """$date today $end
$timescale 1ns $end
$scope module top $end
$var wire 1 ! clk $end
$var reg 4 " data [3:0] $end
$scope module u $end
$var wire 1 ! clk $end
$upscope $end
$upscope $end
$enddefinitions $end
#0
$dumpvars
0!
bxx "
$end
#5
1!
$comment
b1 " $end
#5
b101 "
#3
0!
#7.0
0!
r1.5 "
"""


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_vcd(spark, tmp_path, split):
    (tmp_path / "w.vcd").write_text(VCD)
    vcd.register(spark)
    read = spark.read.format("vcd").option("splitBytes", split)
    got = rows(read.load(f"{tmp_path}/w.vcd"), "time", "seq", "signal")
    whole = [("!", 0, 0, "0"), ('"', 0, 1, "xx"), ("!", 5, 0, "1"), ('"', 5, 1, "101"), ("!", 7, 0, "0"), ('"', 7, 1, "1.5")]
    if split == 1 << 20:
        assert got == whole
    else:  # a step back is seen within a range only
        assert {(s, t, v) for s, t, _, v in whole} <= {(s, t, v) for s, t, _, v in got}
    names = rows(spark.read.format("vcd").option("table", "vars").load(f"{tmp_path}/w.vcd").select("scope", "name", "width", "msb", "lsb"), "scope", "name")
    assert names == [("top", "clk", 1, None, None), ("top", "data", 4, 3, 0), ("top.u", "clk", 1, None, None)]


def test_parameters_and_results(spark, tmp_path):
    tree = '{"modulesp": [{"type": "MODULE", "origName": "m", "stmtsp": [{"type": "ALWAYS", "stmtsp": [{"type": "ASSIGNW", "lhsp": [{"loc": "f,77:1,77:9"}]}]}, {"type": "ASSIGN", "lhsp": [{"loc": "f,79:1,79:2"}]}]}, {"type": "MODULE", "dead": true, "origName": "d", "stmtsp": [{"type": "ASSIGN", "lhsp": [{"loc": "f,1:1,2:2"}]}]}]}'
    assert designs.parameter_lines(tree) == [("m", 77), ("m", 79)]
    (tmp_path / "t.json").write_text(tree)
    assert designs.read_parameters(spark, f"{tmp_path}/t.json").count() == 2
    for bug, text in (("U1", '{"bid": 3, "module_name": "alu", "scope_name": "t"}'), ("init", "{}"), ("M1", '{"module_name": "div"}')):
        (tmp_path / "o" / bug).mkdir(parents=True)
        (tmp_path / "o" / bug / "oracle_info.json").write_text(text)
    assert rows(designs.read_oracles(spark, f"{tmp_path}/o").select("bug_id", "bid", "module_name"), "bug_id") == [("M1", None, "div"), ("U1", 3, "alu")]
    paths = spark.createDataFrame([("/r/U1/llm_2/a.json",), ("/r/U1/llm_10/a.json",), ("/r/M1/llm_1/a.json",), ("/r/x",)], "path string")
    assert rows(designs.latest_result_paths(paths, "llm").select("bug_id", "n"), "bug_id") == [("M1", 1), ("U1", 10)]
    choice = spark.createDataFrame([("U1", 2, "alu", None, 3, 0.5), ("U1", 1, "x", None, 1, 0.9)], "bug_id string, rank int, module_name string, line_number bigint, block_id bigint, score double")
    designs.write_results(choice, f"{tmp_path}/out")
    back = designs.choices(designs.read_results(spark, f"{tmp_path}/out"))
    assert rows(back.select("at", "module_name", "block_id"), "at") == [(0, "x", 1), (1, "alu", 3)]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "m", 1), ("b", "m", None), ("c", "m", 2)], "bug_id string, module string, block_id int")
    choice = spark.createDataFrame([("a", "m", 1, 0.2), ("a", "x", 1, 0.9), ("b", "m", 7, 0.1)], "bug_id string, module string, block_id int, score double")
    assert tuple(api.evaluate(choice, truth).first()) == (3, 1, 2, 2, 2)
    votes = spark.createDataFrame([(1, True, True, False), (1, False, False, True)], "k int, dive boolean, suspicious boolean, terminate boolean")
    assert tuple(evaluate.vote(votes, ["k"]).first()) == (1, False, True, False)
    items = spark.createDataFrame([(x,) for x in "1 2 2 3 3 3".split()], "x string")
    assert rows(evaluate.top_items(items, "x", 10), F.desc("n")) == [("3", 3), ("2", 2), ("1", 1)]
    picked = evaluate.drop_earlier(F.expr("array(named_struct('name','a','time',5), named_struct('name','a','time',3), named_struct('name','b','time',1), named_struct('name','a','time',6))"))
    assert [tuple(x) for x in spark.range(1).select(picked.alias("p")).first().p] == [("a", 5), ("b", 1), ("a", 6)]
    chosen = spark.createDataFrame([(1, "s[3]", 4), (1, "t", 9)], "k int, name string, time int")
    drivers = spark.createDataFrame([(1, "s", 4), (1, "s", 5), (1, "t", 2)], "k int, name string, time int")
    assert rows(evaluate.pick_signals(chosen, drivers, ["k"]), "name") == [(1, "s", 4), (1, "t", 2)]
    price = spark.range(1).select(evaluate.token_price(F.lit(" gpt-4o "), F.lit(1000000), F.lit(500000)).alias("a"), evaluate.token_price(F.lit("none"), F.lit(1), F.lit(1)).alias("b")).first()
    assert price.a == pytest.approx(7.5) and price.b is None
    status = api.validate(spark.createDataFrame([("a", "+++ b\n+ x = y; // no"), ("b", "+zz"), ("c", "-x")], "bug_id string, diff string"), spark.createDataFrame([("a", "if x = y; end"), ("b", "q"), ("c", "q")], "bug_id string, ctx string"))
    assert dict(rows(status, "status")) == {"consistent": 1, "error": 1, "mismatch": 1}


def test_navigation():
    trace = [navigate.Block(1, "m", "t", "ModuleOutput", target="y", signals=(("r", 4),)), navigate.Block(2, "m", "t", "AlwaysSeq", target="r", signals=(("a", 3), ("b", 3))), navigate.Block(3, "m", "t", "Assign", target="a")]
    assert navigate.nav_map(trace)["r"].bid == 1 and navigate.nav_map(trace)["a"].bid == 2
    assert navigate.walk(trace, navigate.mark_all) == [2]
    steps = iter([("check_signals", "r[0]"), ("append_block", None), ("append_block", None), ("exit", None)])
    assert navigate.walk(trace, lambda state: next(steps)) == [1]
    assert navigate.walk(trace[:1], navigate.mark_all) == []
    assert navigate.rerank(trace[:1], lambda b: 0.2) == [(1, 1.0)] and navigate.rerank(trace, lambda b: b.bid)[0] == (3, 3)
    assert navigate.BlockMock(seed=1)([("a", 1)]) == navigate.BlockMock(seed=1)([("a", 1)]) and "dive" in navigate.ModuleMock(seed=2)([])
    assert navigate.fill_prompt("see {a}", {"a": "b"}) == "see b" and navigate.tree(["x/a.sv", "x/b.sv"]) == "x/\n  a.sv\n  b.sv"


def test_stream(spark, tmp_path):
    schema = "signal string, time bigint, seq bigint, value string"
    for k, part in enumerate(([("a", 1, 0, "0"), ("a", 2, 1, "1")], [("a", 1, 2, "x"), ("b", 5, 3, "1"), ("a", 3, 4, "1")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = held.held_values(stream).writeStream.outputMode("update").format("memory").queryName("held").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    last = {r.signal: (r.time, r.value) for r in spark.table("held").orderBy("time").collect()}
    assert last["a"][0] == 3 and last["b"] == (5, "1")


def test_sniff():
    assert [vcd.sniff(x) for x in (b"$date\n", b"GHDLwave\n\0", b"\0" + (329).to_bytes(8, "big"), b"junk", b"")] == ["vcd", "ghw", "fst", "unknown", "unknown"]


def test_mutation_sites(spark, tmp_path):
    (tmp_path / "alu.sv").write_text(SV)
    sites = rtl.read_mutation_sites(spark, str(tmp_path))
    tokens = {(r.line, r.token, r.kind) for r in sites.collect()}
    assert {(3, "+", "operator"), (5, "==", "operator"), (5, "8'h0", "constant")} <= tokens
    assert not any(t == "<=" for _, t, _ in tokens)
    changed = {(r.line, r.token): r.replacement for r in api.mutations(sites).collect()}
    assert changed[3, "+"] == "-" and changed[5, "=="] == "!=" and changed[5, "8'h0"] == "8'h1"


def test_naive_localize():
    sources = {"a.sv": "x\n  y;\ny;", "b.sv": "z"}
    found = api.naive_localize(list(sources), lambda tree: [x for x in tree.split("\n") if x == "a.sv"], lambda s: [("y;", 0.4), ("x", 0.9), ("none", 1.0)], sources)
    assert found == [("a.sv", 1, 0.9), ("a.sv", 2, 0.4)]
