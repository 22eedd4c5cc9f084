"""Value change dumps as a data source of variables and changes.

``spark.read.format("vcd").option("table", "changes").load(path)`` reads byte
ranges of the body in parallel: a task starts at the first time mark in its
range and reads on to the first mark behind it, so every change is read once
and has its time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 16 << 20
VARS = "signal string, scope string, name string, type string, width int, msb int, lsb int"
CHANGES = "signal string, time bigint, seq int, value string"
INDEXED = re.compile(r"^(.*?)\s*(?:\[(-?\d+)(?::(-?\d+))?\])?$")


def _open(path: str):
    from pyarrow.fs import FileSystem

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = FileSystem.from_uri(path) if "://" in path else FileSystem.from_uri("file://" + path)
    return system.open_input_file(inner)


def header(file) -> tuple[list[tuple], int]:
    """Variables of the header, and the offset behind it."""
    text, size = b"", 1 << 16
    while b"$enddefinitions" not in text or b"$end" not in text[text.index(b"$enddefinitions") + 15 :]:
        more = file.read(size)
        if not more:
            raise ValueError("no end of definitions")
        text += more
    stop = text.index(b"$end", text.index(b"$enddefinitions") + 15) + 4
    scopes, rows, seen = [], [], set()
    for kind, rest in re.findall(r"\$(scope|upscope|var)\b(.*?)\$end", text[:stop].decode("latin-1"), re.S):
        words = rest.split()
        if kind == "scope":
            scopes.append(words[1] if len(words) > 1 else "")
        elif kind == "upscope":
            scopes.pop()
        else:
            name, msb, lsb = INDEXED.match(" ".join(words[3:])).groups()
            row = (words[2], ".".join(s for s in scopes if s), name, words[0], max(1, int(words[1])), None if msb is None else int(msb), None if msb is None else int(lsb if lsb is not None else msb))
            if row not in seen:
                seen.add(row)
                rows.append(row)
    return rows, stop


def body(lines: Iterator[tuple[int, bytes]], start: int, end: int, first: bool) -> Iterator[tuple]:
    """Changes of lines (offset, line) whose time mark is in [start, end). Times that go back are skipped."""
    time, live, seq, comment, late = 0, first, 0, False, False
    for at, line in lines:
        words = line.decode("latin-1").split()
        k = 0
        while k < len(words):
            word = words[k]
            k += 1
            if comment:
                comment = word != "$end"
            elif word[0] == "#":
                if at >= end:
                    return
                now = int(float(word[1:]))
                live, late = True, now < time
                if now > time:
                    time, seq = now, 0
            elif word == "$comment":
                comment = True
            elif word == "$dumpall":
                live, time = live or first, max(time, 0)
            elif word[0] in "bBrRsS":
                if live and not late and k < len(words):
                    yield words[k], time, seq, word[1:]
                    seq += 1
                k += 1
            elif word[0] in "01xXzZhHuUwWlL-":
                if live and not late:
                    yield word[1:], time, seq, word[0]
                    seq += 1
            elif word[0] != "$":
                raise ValueError(f"unexpected {word}")


def lines_from(file, start: int, skip: bool) -> Iterator[tuple[int, bytes]]:
    """Lines from an offset on; with ``skip`` from the first line that starts behind it."""
    file.seek(start)
    at, held = start, b""
    while True:
        more = file.read(1 << 20)
        if not more:
            break
        held += more
        *whole, held = held.split(b"\n")
        for line in whole:
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1
    if held and not skip:
        yield at, held


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


class VcdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "changes")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        with _open(self.path) as file:
            size, (_, start) = file.size(), header(file)
        if self.table == "vars":
            return [Range(self.path, 0, 0, True)]
        return [Range(self.path, a, min(a + self.split, size), a == start) for a in range(start, size, self.split)] or [Range(self.path, size, size, True)]

    def read(self, partition):
        with _open(partition.path) as file:
            if self.table == "vars":
                yield from header(file)[0]
                return
            # A line that begins exactly at the start belongs to this range.
            lines = lines_from(file, partition.start if partition.first else partition.start - 1, not partition.first)
            yield from body(lines, partition.start, partition.end, partition.first)


class VcdSource(DataSource):
    @classmethod
    def name(cls):
        return "vcd"

    def schema(self):
        return VARS if self.options.get("table") == "vars" else CHANGES

    def reader(self, schema):
        return VcdReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VcdSource)


def sniff(head: bytes) -> str:
    """The kind of waveform file that starts with some bytes: vcd, fst, ghw or unknown."""
    if head.startswith(b"GHDLwave\n"):
        return "ghw"
    if head[:1] == b"\0" and len(head) >= 9 and int.from_bytes(head[1:9], "big") == 329:
        return "fst"
    if re.match(rb"\s*\$(date|version|timescale|comment|scope|var|attrbegin|enddefinitions)\b", head):
        return "vcd"
    return "unknown"


def kind_of(path: str) -> str:
    with _open(path) as file:
        return sniff(file.read(256))
