"""Co-simulation logs, instruction traces, emulator logs, coverage lines and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX = "[0-9a-fA-F]+"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def hex_number(text: Column) -> Column:
    """The value of up to 16 hex digits as an unsigned decimal; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, 10).cast("decimal(20,0)"))


def mismatch(line: Column) -> Column:
    """What a co-simulation log line says: kind, oracle, dut and failure_time.

    Two dialects: ``PC_MISMATCH ... ORACLE=<hex>`` with ``DUT PC:`` lines, and
    ``PC mismatch, DUT retired : <hex> , but the ISS retired: <hex>``. A value
    of the first that is no hex number counts as 0."""
    text = F.trim(line)
    natural = text.rlike("(?i)pc mismatch")
    kind = F.when(text.contains("PC_MISMATCH") | natural, "Pc").when(text.contains("WE_MISMATCH"), "We").when(text.contains("WADDR_MISMATCH"), "Waddr").when(text.contains("WDATA_MISMATCH"), "Wdata")
    told = hex_number(F.trim(_found(text, r"ORACLE=(.*)$")))
    retired = F.coalesce(hex_number(_found(text, r"(?i)iss retired[^:]*:\s*(\S+)")), F.lit(0).cast("decimal(20,0)"))
    oracle = F.when(told.isNotNull(), told).when(natural & text.rlike("(?i)iss retired"), retired).when(kind.isNotNull(), F.lit(0).cast("decimal(20,0)"))
    dut = F.coalesce(hex_number(F.trim(_found(text, r"^DUT (?:PC|WE|WADDR|WDATA):(.*)$"))), hex_number(_found(text, r"(?i)dut retired\s*:\s*(\S+)")))
    time = _found(text, r"FAILURE: Co-simulation mismatch at time\s+(\d+)").cast("bigint")
    return F.struct(kind.alias("kind"), oracle.alias("oracle"), dut.alias("dut"), time.alias("failure_time"))


def mismatch_report(lines: DataFrame, keys: list[str], order: str, text: str = "line") -> DataFrame:
    """One row per log: of kind, oracle, dut and failure time what was said last."""
    told = lines.select(*keys, order, mismatch(F.col(text)).alias("m")).select(*keys, order, "m.*")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return told.groupBy(*keys).agg(*(last(c) for c in ("kind", "oracle", "dut", "failure_time")))


def instruction(line: Column) -> Column:
    """core, pc, encoding and instruction of a trace line in one of three forms; null for others."""
    text = F.trim(line)
    spoken = rf"^core\s+(\d+):\s+0x({HEX})\s+\(0x({HEX})\)\s+(.+)$"
    table = rf"^\s*\d+\s+\d+\s+({HEX})\s+({HEX})\s+(.+?)\s{{2,}}.*$"
    bare = rf"^\s*\d+\s+\d+\s+({HEX})\s+({HEX})\s+(\S+)\s*$"

    def made(pattern: str, core: Column, first: int) -> Column:
        pc, word, said = (F.regexp_extract(text, pattern, first + k) for k in range(3))
        return F.struct(core.alias("core"), hex_number(pc).alias("pc"), hex_number(word).cast("bigint").alias("encoding"), F.trim(said).alias("instruction"))

    return F.when(text.rlike(spoken), made(spoken, F.regexp_extract(text, spoken, 1).cast("int"), 2)).when(text.rlike(table), made(table, F.lit(0), 1)).when(text.rlike(bare), made(bare, F.lit(0), 1))


def trace_context(lines: DataFrame, keys: list[str], order: str, text: str = "line", last: int = 3) -> DataFrame:
    """The last instructions of each trace, with their place from the end."""
    rows = lines.withColumn("i", instruction(F.col(text))).where("i IS NOT NULL")
    window = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("back", F.row_number().over(window).cast("bigint")).where(F.col("back") <= last).select(*keys, "back", "i.*")


def commits(log: Column) -> Column:
    """Array of commits in an emulator log, of each index the first."""
    pattern = r"\[(\d+)\] commit pc ([0-9a-fA-F]+) inst ([0-9a-fA-F]+) wen (\d) dst (\d+) data ([0-9a-fA-F]+)"
    lines = F.regexp_extract_all(log, F.lit(pattern), F.lit(0))

    def one(line: Column) -> Column:
        part = lambda k: F.regexp_extract(line, pattern, k)
        return F.struct(part(1).cast("int").alias("idx"), hex_number(part(2)).alias("pc"), hex_number(part(3)).cast("bigint").alias("inst"), part(4).cast("int").alias("wen"), part(5).cast("int").alias("dst"), hex_number(part(6)).alias("data"))

    numbered = F.array_sort(F.transform(lines, lambda line, at: F.struct(F.regexp_extract(line, pattern, 1).cast("int").alias("idx"), at.alias("at"), line.alias("line"))))
    # The sorted array is bound to a name, as a lambda would compute it for each element.
    firsts = F.transform(F.array(numbered), lambda found: F.filter(found, lambda x, k: (k == 0) | ~F.get(found, k - 1)["idx"].eqNullSafe(x["idx"])))
    placed = F.array_sort(F.transform(F.get(firsts, F.lit(0)), lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    return F.transform(placed, lambda x: one(x["line"]))


def differences(log: Column) -> Column:
    pattern = r"(\w+) different at pc = 0x([0-9a-fA-F]+), right = 0x([0-9a-fA-F]+), wrong = 0x([0-9a-fA-F]+)"
    part = lambda line, k: F.regexp_extract(line, pattern, k)
    return F.transform(F.regexp_extract_all(log, F.lit(pattern), F.lit(0)), lambda x: F.struct(part(x, 1).alias("field"), hex_number(part(x, 2)).alias("pc"), hex_number(part(x, 3)).alias("right"), hex_number(part(x, 4)).alias("wrong")))


def emulator_report(log: Column) -> Column:
    """Abort pc, counters, commits and mismatches of one emulator log."""
    plain = F.regexp_replace(log, "\x1b\\[[0-9;]*m", "")
    count = lambda pattern: F.replace(_found(plain, pattern), F.lit(",")).cast("bigint")
    abort = hex_number(_found(plain, r"ABORT at pc = 0x([0-9a-fA-F]+)"))
    done, unlike = commits(plain), differences(plain)
    wrong = F.get(F.filter(unlike, lambda d: d["field"] == "pc"), F.lit(0))
    inferred = (F.size(unlike) == 0) & (F.size(done) > 0) & abort.isNotNull()
    return F.struct(
        abort.alias("abort_pc"),
        count(r"Core-0 instrCnt = ([\d,]+)").alias("instr_cnt"),
        count(r"cycleCnt = ([\d,]+)").alias("cycle_cnt"),
        count(r"Guest cycle spent: ([\d,]+)").alias("guest_cycle"),
        done.alias("commits"),
        unlike.alias("mismatches"),
        F.when(inferred, abort).otherwise(wrong["wrong"]).alias("dut_pc"),
        F.when(inferred, F.try_element_at(done, F.lit(-1))["data"]).otherwise(wrong["right"]).alias("ref_pc"),
    )


def start_signal(field: Column) -> Column:
    """The signal to start at for the first mismatching field."""
    # Named registers that are written through the output bits.
    written = F.startswith(field, F.lit("x")) | field.isin("ra", "sp", "gp", "tp", "t0", "a0")
    return F.when(F.coalesce(written, F.lit(False)), "io_out_bits").otherwise("io_redirect_target")


def start_time(failure: Column, step: Column) -> Column:
    return failure - 1 - step


def time_bound(start: Column, step: Column, count: Column | None = None) -> Column:
    """Four steps back, or as many as instructions were counted (15 if unknown), not below 0."""
    if count is None:
        return start - 4 * step
    return F.greatest(start - F.coalesce(count, F.lit(15)) * step, F.lit(0))


def report_text(kind: Column, instruction_: Column, dut: Column, oracle: Column) -> Column:
    """The sentence of a test report about a mismatch."""
    word = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c.cast("bigint"))), 8, "0"))
    told = F.format_string
    truth = lambda c: F.when(c != 0, "true").otherwise("false")
    # The sentences of a report, without and with a known instruction.
    bare = (
        F.when(kind == "Pc", told("PC mismatch detected: Expected PC %s, but got %s\n\n", word(oracle), word(dut)))
        .when(kind == "We", told("Write enable mismatch detected: Expected WE %s, but got %s\n\n", truth(oracle), truth(dut)))
        .when(kind == "Waddr", told("Write address mismatch detected: Expected WADDR %s, but got %s\n\n", word(oracle), word(dut)))
        .when(kind == "Wdata", told("Write data mismatch detected: Expected WDATA %s, but got %s\n\n", word(oracle), word(dut)))
    )
    return F.when(instruction_.isNull(), bare).otherwise(
        F.when(kind == "Pc", told("Now this core design is buggy when executing the instruction:\n %s \nAfter executing this instruction, this core jumps to a wrong address %s which should jump to address %s\n\n", instruction_, word(dut), word(oracle)))
        .when(kind == "We", told("Now this core design is buggy when executing a instruction. %s this instruction %s but %s.\n\n", instruction_, F.when(oracle != 0, "should write to register").otherwise("should not write to register"), F.when(dut != 0, "is writing to register").otherwise("is not writing to register")))
        .when(kind == "Waddr", told("Now this core design is buggy when executing a instruction. %s this instruction writes to wrong register address %s which should write to register address %s.\n\n", instruction_, word(dut), word(oracle)))
        .when(kind == "Wdata", told("Now this core design is buggy when executing a instruction. %s this instruction writes wrong data %s to register which should write data %s.\n\n", instruction_, word(dut), word(oracle)))
    )


# Coverage lines: C '\x01key\x02value...' count


def coverage_line(line: Column) -> Column:
    """(point, count) of a line; null for the header and malformed lines."""
    parts = F.split(line, " ")
    points = F.filter(parts, lambda p: (F.char_length(p) > 1) & F.startswith(p, F.lit("'")) & F.endswith(p, F.lit("'")))
    counts = F.filter(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("bigint"))), lambda c: c.isNotNull())
    point = F.get(points, F.lit(0))
    made = F.struct(F.substring(point, F.lit(2), F.char_length(point) - 2).alias("point"), F.get(counts, F.lit(0)).alias("count"))
    return F.when(~F.startswith(line, F.lit("#")) & point.isNotNull() & (F.size(counts) > 0), made)


def point_key(point: Column, key: str) -> Column:
    """The value of a key of a point; null without it."""
    return _found(point, f"\x01{key}\x02([^\x01]*)")


def point_number(point: Column, key: str) -> Column:
    return F.coalesce(point_key(point, key).try_cast("int"), F.lit(0))


def file_time(path: Column) -> Column:
    """The time in a coverage file's name, and its kind; files of neither kind have none."""
    time = _found(path, r"coverage_[a-z_]*(\d+)[a-z_]*\.dat$").cast("bigint")
    kind = F.when(F.endswith(path, F.lit("comb.dat")), "comb").when(F.endswith(path, F.lit("seq.dat")), "seq")
    return F.struct(time.alias("time"), kind.alias("kind"))


def read_coverage(spark, folder: str) -> DataFrame:
    """Coverage rows (file, scope, kind, time, line, count) of a folder of reports."""
    raw = spark.read.text(folder).select(file_time(F.input_file_name()).alias("f"), coverage_line(F.col("value")).alias("c"))
    rows = raw.where("f.kind IS NOT NULL AND c IS NOT NULL").select("f.*", "c.*")
    from faultspark.functions.names import parse_numbers

    point = F.col("point")
    lines = F.coalesce(point_key(point, "S"), point_key(point, "l"), F.lit(""))
    return rows.select(point_key(point, "f").alias("file"), point_key(point, "h").alias("scope"), "kind", "time", F.explode(parse_numbers(lines)).alias("line"), "count")


# Replies


def reply_json(text: Column) -> Column:
    """The fenced json of a reply, else its widest braces; null without either."""
    fenced = r"(?s)```json\s*(.*?)\s*```"
    braces = r"(?s)(\{.*\})"
    return F.coalesce(_found(text, fenced), _found(text, braces))


def first_added(diff: Column) -> Column:
    """The first added line of a diff that isn't blank, without its // comment."""
    lines = F.filter(F.split(diff, "\n"), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")) & (F.trim(F.substring(x, 2, 1 << 30)) != ""))
    line = F.trim(F.substring(F.get(lines, F.lit(0)), 2, 1 << 30))
    return F.trim(F.regexp_replace(line, "//.*$", ""))
