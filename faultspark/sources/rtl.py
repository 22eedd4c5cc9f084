"""RTL sources as tables of blocks, def-use pairs, instances and connections.

A parser for the subset that designs are analysed in: modules with ANSI ports,
wires with initialisers, continuous assigns, always blocks of if, case and
assignments, generate labels, and instances with named connections. A file
counts as its first module. Files are parsed in parallel, one at a time in a
task; files that cannot be parsed give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.lineage import cut

TOKEN = re.compile(r"""(?P<name>\\\S+|[A-Za-z_$`][\w$]*)|(?P<number>\d*'[sS]?[bodhBODH][0-9a-fA-FxXzZ?_]+|'[01xz]|\d[\d_.]*)|(?P<string>"(?:\\.|[^"\\])*")|(?P<op><<<=|>>>=|<<=|>>=|<<<|>>>|<=|>=|==\??|!=\??|&&|\|\||\*\*|\+:|-:|::|->|\S)""", re.X)
# Keywords that are no signal names.
KEYWORDS = frozenset(
    "module endmodule input output inout wire logic reg assign always always_ff always_comb always_latch if else case casez casex endcase begin end default posedge negedge or unique unique0 priority "
    "generate endgenerate genvar for parameter localparam signed unsigned integer int bit byte var typedef enum struct packed function endfunction task endtask return initial import inside tri".split()
)
ROWS = "file string, module string, block int, kind string, seq boolean, name string, other string, line int, at int, len int, text string"


@dataclass
class Token:
    kind: str
    text: str
    at: int
    line: int


@dataclass
class Parser:
    """Walks the tokens of one source; rows are collected as dictionaries."""

    source: str
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self):
        blank = lambda m: re.sub(r"[^\n]", " ", m[0])
        clean = re.sub(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*.*?\*/|\(\*(?!\s*\)).*?\*\)', lambda m: m[0] if m[0][0] == '"' else blank(m), self.source, flags=re.S)
        clean = re.sub(r"^\s*`(timescale|include|define|ifdef|ifndef|endif|else|undef|default_nettype)[^\n]*", blank, clean, flags=re.M)
        self.tokens = []
        line, last = 1, 0
        for m in TOKEN.finditer(clean):
            line += clean.count("\n", last, m.start())
            last = m.start()
            self.tokens.append(Token(m.lastgroup, m[0], m.start(), line))
        self.i, self.module, self.block = 0, "", 0

    # Tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead].text if self.i + ahead < len(self.tokens) else ""

    def next(self) -> Token:
        if self.i >= len(self.tokens):
            raise SyntaxError("unexpected end")
        self.i += 1
        return self.tokens[self.i - 1]

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SyntaxError(f"{text} expected, not {self.peek()}")

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to a stop outside of brackets; the stop stays."""
        out, depth = [], 0
        while self.i < len(self.tokens) and not (depth == 0 and self.peek() in stops):
            t = self.next()
            depth += (t.text in "([{") - (t.text in ")]}") if len(t.text) == 1 else 0
            out.append(t)
        return out

    def group(self) -> list[Token]:
        self.need("(")
        out = self.until(")")
        self.need(")")
        return out

    @staticmethod
    def names(tokens: list[Token]) -> list[Token]:
        """Identifiers and literals of an expression, without select indices and members of casts."""
        out, depth = [], 0
        for k, t in enumerate(tokens):
            if t.text == "[":
                depth += 1
            elif t.text == "]":
                depth -= 1
            elif depth == 0 and t.kind == "name" and t.text not in KEYWORDS and t.text[0] != "$":
                if k and tokens[k - 1].text in (".", "::") or k + 1 < len(tokens) and tokens[k + 1].text in ("::", "'"):
                    continue
                out.append(t)
        return out

    # Rows

    def put(self, kind: str, name: str = "", other: str = "", line: int = 0, at: int = 0, size: int = 0, seq: bool = False, text: str = "") -> None:
        self.rows.append({"module": self.module, "block": self.block, "kind": kind, "seq": seq, "name": name, "other": other, "line": line, "at": at, "len": size, "text": text})

    def defines(self, left: list[Token], right: list[Token], guards: list[Token], seq: bool) -> None:
        for out in self.names(left):
            self.put("output", out.text, line=out.line, at=out.at, size=len(out.text), seq=seq)
            for src in {t.text: t for t in [*self.names(right), *guards]}.values():
                self.put("flow", out.text, src.text, out.line, src.at, len(src.text), seq)

    def begin_block(self, kind: str, start: int, seq: bool = False) -> None:
        self.block += 1
        self.kind, self.start, self.seq = kind, start, seq

    def end_block(self) -> None:
        first, last = self.tokens[self.start], self.tokens[self.i - 1]
        end = last.at + len(last.text)
        self.put(self.kind, line=first.line, at=first.at, size=end - first.at, seq=self.seq, text=self.source[first.at : end])

    # Grammar

    def parse(self) -> list[dict]:
        while self.peek() and self.peek() != "module":
            self.i += 1
        self.need("module")
        self.module = self.next().text
        if self.take("#"):
            self.group()
        if self.peek() == "(":
            self.ports(self.group())
        self.need(";")
        self.items("endmodule", "")
        return self.rows

    def ports(self, tokens: list[Token]) -> None:
        direction, depth, part = "", 0, []
        for t in [*tokens, Token("op", ",", 0, 0)]:
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            if t.text == "," and depth == 0:
                names = self.names(part)
                for d in part:
                    if d.text in ("input", "output", "inout"):
                        direction = d.text
                if names and direction in ("input", "output"):
                    self.port(direction, names[-1])
                part = []
            else:
                part.append(t)

    def port(self, direction: str, name: Token) -> None:
        self.block += 1
        kind = "ModuleInput" if direction == "input" else "ModuleOutput"
        self.put(kind, name.text, line=name.line, at=name.at, size=len(name.text), text=f"{direction} {name.text}")
        self.put("output", name.text, line=name.line, at=name.at, size=len(name.text))

    def items(self, end: str, label: str) -> None:
        while not self.take(end):
            if not self.peek():
                raise SyntaxError(f"{end} expected")
            self.item(label)

    def item(self, label: str) -> None:
        word, start = self.peek(), self.i
        if word in ("always", "always_ff", "always_comb", "always_latch"):
            self.next()
            if self.take("@") and not self.take("*"):
                self.group()
            seq = word != "always_comb"
            self.begin_block("AlwaysComb" if word == "always_comb" else "AlwaysSeq", start, seq)
            self.statement([], seq)
            self.end_block()
        elif word == "assign":
            self.next()
            self.begin_block("Assign", start)
            while True:
                left = self.until("=")
                self.need("=")
                self.defines(left, self.until(",", ";"), [], False)
                if not self.take(","):
                    break
            self.need(";")
            self.end_block()
        elif word in ("input", "output", "inout"):
            self.next()
            for name in self.names(self.until(";")):
                if word != "inout":
                    self.port(word, name)
            self.need(";")
        elif word in ("wire", "logic", "reg", "tri", "var"):
            self.declaration(start)
        elif word in ("generate", "endgenerate"):
            self.next()
        elif word in ("if", "for"):
            self.next()
            self.group()
            self.generated(label)
            if self.take("else"):
                self.generated(label) if self.peek() != "if" else self.item(label)
        elif word == "begin":
            self.generated(label)
        elif word in ("function", "task"):
            while not self.take("end" + word):
                self.next()
        elif word == "initial":
            self.next()
            self.skip()
        elif self.tokens[self.i].kind == "name" and word not in KEYWORDS and (self.peek(1) == "#" or self.peek(2) == "(" and self.peek(1) not in KEYWORDS):
            self.instance(label)
        else:
            self.until(";")
            self.need(";")

    def generated(self, label: str) -> None:
        if not self.take("begin"):
            self.item(label)
            return
        name = ""
        if self.take(":"):
            name = self.next().text
        self.items("end", f"{label}{name}." if name else label)
        if self.take(":"):
            self.next()

    def declaration(self, start: int) -> None:
        """A net declaration; the first initialised name of it is a block."""
        self.next()
        done = False
        while True:
            left = self.until("=", ",", ";")
            names = self.names(left)
            if names:
                self.put("signal", names[-1].text, line=names[-1].line, at=names[-1].at, size=len(names[-1].text))
            if self.take("="):
                right = self.until(",", ";")
                if not done and names:
                    self.begin_block("Assign", start)
                    self.defines(names[-1:], right, [], False)
                    self.end_block()
                    done = True
            if not self.take(","):
                break
        self.need(";")

    def instance(self, label: str) -> None:
        child = self.next().text
        if self.take("#"):
            self.group()
        name = self.next()
        self.put("instance", label + name.text, child, name.line, name.at, len(name.text))
        self.need("(")
        while not self.take(")"):
            if self.take("."):
                port = self.next()
                inner = self.group() if self.peek() == "(" else [port]
                for signal in self.names(inner):
                    self.put("connection", label + name.text + "." + port.text, signal.text, port.line, port.at, len(port.text))
            else:
                self.until(",", ")")
            self.take(",")
        self.need(";")

    def skip(self) -> None:
        if self.take("begin"):
            depth = 1
            while depth:
                word = self.next().text
                depth += (word == "begin") - (word == "end")
        else:
            self.until(";")
            self.need(";")

    def statement(self, guards: list[Token], seq: bool) -> None:
        if self.take("begin"):
            if self.take(":"):
                self.next()
            while not self.take("end"):
                self.statement(guards, seq)
            if self.take(":"):
                self.next()
        elif self.peek() in ("unique", "unique0", "priority"):
            self.next()
            self.statement(guards, seq)
        elif self.take("if"):
            inner = [*guards, *self.names(self.group())]
            self.statement(inner, seq)
            if self.take("else"):
                self.statement(inner, seq)
        elif self.peek() in ("case", "casez", "casex"):
            self.next()
            subject = self.names(self.group())
            self.take("inside")
            while not self.take("endcase"):
                labels = [] if self.take("default") else self.names(self.until(":"))
                self.take(":")
                self.statement([*guards, *subject, *labels], seq)
        elif self.take("for"):
            self.group()
            self.statement(guards, seq)
        elif not self.take(";"):
            left = self.until("<=", "=", ";")
            if self.peek() in ("<=", "="):
                self.next()
                self.defines(left, self.until(";"), guards, seq)
            self.need(";")


def parse(source: str) -> list[dict]:
    """Rows of a source; none if it cannot be parsed."""
    try:
        return Parser(source).parse()
    except (SyntaxError, IndexError):
        return []


def read_rtl(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all .sv and .v files of a folder: blocks, outputs, flow, instances and connections."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{sv,v}").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows = parse(bytes(content).decode("utf-8", "replace"))
                if rows:
                    yield pd.DataFrame([{"file": path, **r} for r in rows])[[c.split()[0] for c in ROWS.split(", ")]]

    return files.mapInPandas(run, ROWS)


def elaborate(rows: DataFrame, top: str, depth: int = 64) -> DataFrame:
    """(scope, module, level) of all instances below a top module; unknown modules are skipped."""
    instances = cut(rows.where("kind = 'instance'").select("module", F.col("name").alias("inst"), F.col("other").alias("child")))
    modules = rows.select(F.col("module").alias("child")).distinct()
    known = cut(instances.join(modules, "child", "left_semi"))
    level = rows.where(F.col("module") == top).select(F.col("module").alias("scope"), "module").distinct().withColumn("level", F.lit(0))
    out = level
    for k in range(1, depth):
        level = cut(level.join(known, "module").select(F.concat_ws(".", "scope", "inst").alias("scope"), F.col("child").alias("module"), F.lit(k).alias("level")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("modules are nested too deep or in a circle")


def scope_blocks(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Blocks of every scope with their bid: numbered by level, scope and place in the source."""
    kinds = ("ModuleInput", "ModuleOutput", "AlwaysSeq", "AlwaysComb", "Assign")
    blocks = rows.where(F.col("kind").isin(*kinds)).select("module", "block", F.col("kind").alias("btype"), "seq", "line", "at", "len", "text")
    from pyspark.sql import Window

    joined = scopes.join(blocks, "module")
    place = joined.groupBy(F.col("level").alias("_v"), F.col("scope").alias("_s")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_v", "_s").rowsBetween(Window.unboundedPreceding, -1)
    place = place.select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = joined.withColumn("_k", F.row_number().over(Window.partitionBy("scope").orderBy("at", "block")) - 1)
    return own.join(place, F.col("scope") == F.col("_s")).withColumn("bid", F.col("_before") + F.col("_k")).drop("_s", "_before", "_k")


def scope_flow(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(bid, scope, seq, line, out, src) for slices; lines of assigns and ports are null."""
    flow = rows.where("kind = 'flow'").select("module", "block", F.col("line").alias("_line"), F.col("name").alias("out"), F.col("other").alias("src"))
    joined = blocks.select("bid", "scope", "module", "block", "btype", "seq").join(flow, ["module", "block"])
    return joined.select("bid", "scope", "seq", F.when(F.col("btype").isin("AlwaysSeq", "AlwaysComb"), F.col("_line")).alias("line"), "out", "src")


def port_map(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """(parent_scope, child_scope, port, signal) of named connections."""
    wired = rows.where("kind = 'connection'").select("module", F.regexp_extract("name", r"^(.*)\.([^.]*)$", 1).alias("inst"), F.regexp_extract("name", r"^(.*)\.([^.]*)$", 2).alias("port"), F.col("other").alias("signal"))
    return scopes.join(wired, "module").select(F.col("scope").alias("parent_scope"), F.concat_ws(".", "scope", "inst").alias("child_scope"), "port", "signal")


def signal_map(rows: DataFrame) -> DataFrame:
    """(module, map of port to canonical name) of the ports that have one."""
    from faultspark.functions.names import canonical_port

    ports = rows.where("kind IN ('ModuleInput', 'ModuleOutput')").select("module", F.col("name").alias("port"), canonical_port(F.col("name")).alias("canonical")).where("canonical IS NOT NULL").distinct()
    return ports.groupBy("module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("port", "canonical")))).alias("ports"))


SITES = "file string, module string, line int, at int, len int, token string, kind string"


def mutation_sites(source: str) -> list[dict]:
    """Places of a source whose token may be mutated: operators between operands, and constants."""
    from faultspark.operators.mutate import OPERATORS

    try:
        parser = Parser(source)
        parser.parse()
    except (SyntaxError, IndexError):
        return []
    out, tokens = [], parser.tokens
    for before, t, after in zip(tokens, tokens[1:], tokens[2:]):
        operand = before.kind in ("name", "number") and before.text not in KEYWORDS or before.text in (")", "]", "}")
        # Between two operands <= compares only inside brackets or behind an assignment; statements are told by the parser.
        if t.kind == "op" and t.text in OPERATORS and operand and after.text not in (")", "]", ";", ","):
            out.append({"module": parser.module, "line": t.line, "at": t.at, "len": len(t.text), "token": t.text, "kind": "operator"})
        elif t.kind == "number":
            out.append({"module": parser.module, "line": t.line, "at": t.at, "len": len(t.text), "token": t.text, "kind": "constant"})
    assigned = {r["at"] for r in parser.rows if r["kind"] == "output"}
    names = {t.at: k for k, t in enumerate(tokens)}
    starts = {tokens[names[a] + 1].at for a in assigned if a in names and names[a] + 1 < len(tokens)}
    return [r for r in out if not (r["token"] == "<=" and r["at"] in starts)]


def read_mutation_sites(spark: SparkSession, folder: str) -> DataFrame:
    """``mutation_sites`` of all .sv and .v files of a folder."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{sv,v}").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows = mutation_sites(bytes(content).decode("utf-8", "replace"))
                if rows:
                    yield pd.DataFrame([{"file": path, **r} for r in rows])[[c.split()[0] for c in SITES.split(", ")]]

    return files.mapInPandas(run, SITES)
