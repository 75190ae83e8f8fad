"""Traces as text, CSV, JSON lines and Parquet: read into timelines, written from output events.

A text trace has a line for each event, ``ts: stream = value`` or ``ts: stream`` (unit). A time may be a
range (``a..b``, ``a,b..c``, ``a <= t < b``), which stands for an event at each of its times; the value may
use the range's variable. Values are constant expressions. Lines are parsed where Spark reads them.

Two events of one stream at the same time are an error, unless a trace is read as ``repeated``: then what each
line (of CSV and JSON: row) has at a time is a tick of its own, in the order of the lines.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline import find_package
from tideline.functions import scalars  # noqa: F401  (registers the functions)
from tideline.functions import types as t
from tideline.functions.expr import FUNCTIONS, Fault
from tideline.operators.timeline import TS, Timeline, from_events, written
from tideline.plans.syntax import SpecError, parse_expression

_TIME = re.compile(
    r"""^\s*(?:(?P<low>\d+)\s*(?P<lowop><=?)\s*(?P<var>[^\W\d]\w*)\s*(?:(?P<highop><=?)\s*(?P<high>\d+))?
    |(?P<first>\d+)\s*(?:,\s*(?P<second>\d+)\s*)?\.\.\s*(?P<last>\d+)?
    |(?P<single>\d+))\s*$""",
    re.X,
)


class TraceError(Exception):
    """A line of a trace that can't be read, or an event that doesn't fit its stream."""


def times(text: str, until: int | None = None) -> tuple[range, str | None]:
    """The times that a time or range stands for, and its variable. Open ranges end at ``until``."""
    m = _TIME.match(text)
    if m is None:
        raise TraceError(f"no time: {text.strip()!r}")
    g = m.groupdict()
    if g["single"] is not None:
        at = int(g["single"])
        return range(at, at + 1), None
    if g["low"] is not None:
        low = int(g["low"]) + (g["lowop"] == "<")
        high, step, variable = (int(g["high"]) - (g["highop"] == "<") if g["high"] else None), 1, g["var"]
    else:
        low = int(g["first"])
        step = int(g["second"]) - low if g["second"] else 1
        high, variable = (int(g["last"]) if g["last"] else None), None
        if step <= 0:
            raise TraceError(f"a range must have a positive step: {text.strip()!r}")
    if high is None:
        if until is None:
            raise TraceError(f"an open range needs an end: {text.strip()!r}")
        high = until
    return range(low, high + 1, step), variable


_COLLECTIONS = {"List": tuple, "Set": frozenset}
_OPS = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod", "<<": "leftshift", ">>": "rightshift", "&": "bitand", "|": "bitor", "^": "bitxor", "==": "eq", "!=": "neq", "<": "lt", ">": "gt", "<=": "leq", ">=": "geq"}
_COMPARE = {"==": operator.eq, "!=": operator.ne}


def value_of(e: tuple, env: dict[str, Any]) -> Any:
    """A trace's expression in Python."""
    kind = e[0]
    if kind == "literal":
        return e[1]
    if kind == "string":
        return "".join(p if isinstance(p, str) else t.show(value_of(p[1], env)) for p in e[1])
    if kind == "name":
        if e[1] in ("true", "false"):
            return e[1] == "true"
        if e[1] == "None":
            return None
        if e[1] in env:
            return env[e[1]]
        raise TraceError(f"{e[1]} is not defined")
    if kind == "object":
        return t.Record((n, value_of(x, env)) for n, x in e[1])
    if kind == "prefix":
        x = value_of(e[2], env)
        return {"!": operator.not_, "~": operator.invert, "-": operator.neg}[e[1]](x)
    if kind == "if":
        return value_of(e[3] if value_of(e[2], env) else e[4], env)
    if kind == "infix":
        if e[1] in ("&&", "||"):
            a = value_of(e[2], env)
            return a if a == (e[1] == "||") else value_of(e[3], env)
        a, b = value_of(e[2], env), value_of(e[3], env)
        if e[1] not in _OPS:
            raise TraceError(f"operator {e[1]} is not allowed in a trace")
        if e[1] in _COMPARE:
            return _COMPARE[e[1]](a, b)
        out = FUNCTIONS[_OPS[e[1]]].python(a, b)
        if isinstance(out, Fault):
            raise TraceError(str(out))
        return out
    if kind == "call" and e[1][0] == "name" and e[2] is not None:
        name = e[1][1]
        if name == "Map":
            return t.FrozenMap((value_of(entry[2][0][1], env), value_of(entry[2][1][1], env)) for _, entry in e[2])
        args = [value_of(x, env) for _, x in e[2]]
        if name == "Some" and len(args) == 1:
            return t.Some(args[0])
        if name in _COLLECTIONS:
            return _COLLECTIONS[name](args)
    raise TraceError("no value of a trace")


def _fit(value: Any, kind: t.Type, stream: str) -> Any:
    try:
        if t.unify(t.type_of(value), kind) != kind:
            raise TypeError
    except TypeError:
        raise TraceError(f"{stream} takes {kind}, not {t.show(value, True)}") from None
    return t.encode(value, kind)


@functools.lru_cache(maxsize=4096)
def _parsed(text: str) -> tuple:
    return parse_expression(_arrows(text))


def _arrows(text: str) -> str:
    """Map entries ``k -> v`` as pairs, which the expression parser reads."""
    if "->" not in text:
        return text
    out, i, depth, marks = [], 0, 0, []
    start = {}
    quoted = False
    for i, c in enumerate(text):
        if c == '"' and (i == 0 or text[i - 1] != "\\"):
            quoted = not quoted
        if quoted:
            continue
        if c in "([{":
            depth += 1
            start[depth] = i + 1
        elif c in ")]}":
            if depth in marks:
                marks.remove(depth)
                out.append((i, ")"))
            depth -= 1
        elif c == ",":
            if depth in marks:
                marks.remove(depth)
                out.append((i, ")"))
            start[depth] = i + 1
        elif text.startswith("->", i):
            out += [(start.get(depth, 0), "_entry("), (i, ",\0")]
            marks.append(depth)
    result, at = "", 0
    for place, what in sorted(out, key=lambda x: x[0]):
        result += text[at:place] + what.replace("\0", "")
        at = place + (2 if what.endswith("\0") else 0)
    return result + text[at:]


def events_of_line(line: str, types: dict[str, t.Type], until: int | None = None) -> Iterator[tuple[int, str, Any]]:
    """(ts, stream, Spark value) of a text trace's line; events of undeclared streams have no value."""
    body = _uncommented(line)
    if not body.strip():
        return
    left, colon, right = body.partition(":")
    m = re.match(r"\s*([^\W\d]\w*)\s*(?:=(?P<value>.*))?$", right, re.S)
    if not colon or m is None:
        raise TraceError(f"no event: {line.strip()!r}")
    stream, text = m.group(1), m.group("value")
    at, variable = times(left, until)
    try:
        parsed = None if text is None else _parsed(text.strip())
        for ts in at:
            if stream not in types:
                yield ts, stream, None
                continue
            value = t.NOTHING if parsed is None else value_of(parsed, {variable: ts} if variable else {})
            yield ts, stream, _fit(value, types[stream], stream)
    except SpecError as error:
        raise TraceError(f"{line.strip()!r}: {error}") from error


def _uncommented(line: str) -> str:
    quoted = False
    for i, c in enumerate(line):
        if c == '"' and (i == 0 or line[i - 1] != "\\"):
            quoted = not quoted
        if not quoted and (c == "#" or line.startswith("--", i) and not re.match(r"--\d", line[i:])):
            return line[:i]
    return line


class _Lines:
    """Parses lines into rows (_at, ts, streams...), in the order of the file. A row has one event, or with ``whole`` all of its line at a time."""

    def __init__(self, types: dict[str, t.Type], schema: pa.Schema | None, until: int | None, header: list[str] | None, whole: bool = False) -> None:
        self.types, self.schema, self.until, self.header, self.whole = types, schema, until, header, whole

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = events_of_line(line, self.types, self.until) if self.header is None else self.cells(line)
                if self.whole:
                    rows += self.ticks(place, found)
                    continue
                for ts, stream, value in found:
                    rows.append({"_at": place, TS: ts, stream: value} if stream in self.types else {"_at": place, TS: ts})
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], self.schema)

    def ticks(self, place: int, found: Iterable[tuple[int, str, Any]]) -> Iterable[dict[str, Any]]:
        rows: dict[int, dict[str, Any]] = {}
        for ts, stream, value in found:
            row = rows.setdefault(ts, {"_at": place, TS: ts})
            if stream in self.types:
                if stream in row:
                    raise TraceError(f"two events of {stream} at {ts} in one line")
                row[stream] = value
        return rows.values()

    def cells(self, line: str) -> Iterator[tuple[int, str, Any]]:
        if not line.strip():
            return
        parts = split_cells(line)
        at, variable = times(parts[0], self.until)
        for stream, cell in zip(self.header[1:], parts[1:], strict=False):
            if cell.strip():
                parsed = _parsed(cell.strip())
                for ts in at:
                    yield ts, stream, _fit(value_of(parsed, {variable: ts} if variable else {}), self.types[stream], stream) if stream in self.types else None
        if not any(c.strip() for c in parts[1:]):
            for ts in at:
                yield ts, "", None


def events_of_lines(lines: Iterable[str], types: dict[str, t.Type], until: int | None = None, csv: bool = False) -> Iterator[tuple[int, str, Any]]:
    """The events of a trace's lines as they come. Ranges are expanded line by line, so time must not go backwards between lines."""
    rows = iter(lines)
    cells = _Lines(types, None, until, [c.strip() for c in next(rows, "").split(",")]).cells if csv else None
    for line in rows:
        for found in events_of_line(line, types, until) if cells is None else sorted(filter(None, cells(line.rstrip("\n"))), key=lambda e: e[0]):
            yield found


def split_cells(line: str) -> list[str]:
    """A CSV trace's line at its commas outside brackets and strings."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(line):
        if c == '"' and (i == 0 or line[i - 1] != "\\"):
            quoted = not quoted
        elif not quoted:
            depth += (c in "([{") - (c in ")]}")
            if c == "," and depth == 0:
                out.append(line[start:i])
                start = i + 1
    return [*out, line[start:].rstrip("\n")]


def _timeline(lines: DataFrame, types: dict[str, t.Type], until: int | None, header: list[str] | None, abort_at: int | None, repeated: bool) -> Timeline:
    find_package(lines.sparkSession)
    schema = T.StructType([T.StructField("_at", T.LongType()), T.StructField(TS, T.LongType()), *(T.StructField(n, k.spark) for n, k in types.items())])
    rows = lines.mapInArrow(_Lines(types, to_arrow_schema(schema), until, header, repeated and abort_at is None), schema)
    if abort_at is not None:
        # the n + 1 first events, in the order of the file
        rows = rows.orderBy(TS, "_at").limit(abort_at + 1)
        if repeated:
            rows = rows.groupBy("_at", TS).agg(*(F.first(n, ignorenulls=True).alias(n) for n in types))
    rows = written(rows)
    _check_order(rows)
    return from_events(rows, {n: F.col(n) for n in types}, order=("_at",) if repeated else ())


def _check_order(rows: DataFrame) -> None:
    """Time must not go backwards from line to line; each partition is a stretch of the file, of which only the ends are compared here."""
    lines = rows.groupBy("_at").agg(F.min(TS).alias(TS)).withColumn("part", F.shiftright("_at", 33))
    inside = lines.groupBy("part").agg(F.min(TS).alias("low"), F.max(TS).alias("high")).orderBy("part")
    ordered = inside.withColumn("before", F.expr("max(high) over (order by part rows between unbounded preceding and 1 preceding)")).where("low < before")
    bad = ordered.first()
    if bad is None:
        w = F.expr(f"lag({TS}) over (partition by part order by _at)")
        bad = lines.withColumn("before", w).where(f"{TS} < before").first()
    if bad is not None:
        raise TraceError(f"time goes backwards, to {bad['low'] if 'low' in bad else bad[TS]} from {bad['before']}")


def _numbered(df: DataFrame) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("_at"), F.col("value"))


def read_text(spark: SparkSession, path: str, types: dict[str, t.Type], until: int | None = None, abort_at: int | None = None, repeated: bool = False) -> Timeline:
    """A text trace as a timeline with a column for each declared stream."""
    return _timeline(_numbered(spark.read.text(path)), types, until, None, abort_at, repeated)


def read_csv(spark: SparkSession, path: str, types: dict[str, t.Type], until: int | None = None, abort_at: int | None = None, repeated: bool = False) -> Timeline:
    """A CSV trace: the header names the streams, the first column is the time, an empty cell is no event."""
    lines = spark.read.text(path)
    first = lines.first()
    header = [] if first is None else [c.strip() for c in first["value"].split(",")]
    body = _numbered(lines).where("_at > 0")
    return _timeline(body, types, until, header, abort_at, repeated)


def read_json(spark: SparkSession, path: str, types: dict[str, t.Type], keys: tuple[str, ...] = (), split: bool = False, repeated: bool = False) -> Timeline:
    """JSON lines with ``ts``, the key columns and a member for each stream that has an event."""
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), T.StructField(TS, T.LongType()), *(T.StructField(n, k.spark) for n, k in types.items())])
    rows = spark.read.schema(schema).json(path)
    if repeated:
        rows = rows.withColumn("_at", F.monotonically_increasing_id())
    return from_events(rows, {n: F.col(n) for n in types}, keys, split=split, order=("_at",) if repeated else ())


def read_parquet(spark: SparkSession, path: str, types: dict[str, t.Type], keys: tuple[str, ...] = (), ts: str = TS, unique: bool = False, split: bool = False) -> Timeline:
    """A wide Parquet table: time, key columns and a nullable column for each stream."""
    return from_events(spark.read.parquet(path), {n: F.col(n).cast(k.spark) for n, k in types.items()}, keys, ts, unique, split)


# output events: keys, ts, stream, value

def rendered(events: DataFrame, raw: Iterable[str] = ()) -> DataFrame:
    """Output events as lines; unit events too are written with their value. ``raw`` streams give their bare values."""
    line = F.concat(F.col(TS).cast("string"), F.lit(": "), F.col("stream"), F.lit(" = "), F.col("value"))
    names = list(raw)
    return events.withColumn("line", F.when(F.col("stream").isin(names), F.col("value")).otherwise(line) if names else line)


def stop_on(events: DataFrame, stream: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The events up to the first tick of ``stream``."""
    end = events.where(F.col("stream") == stream).groupBy(*keys).agg(F.min(TS).alias("_end"))
    if not keys:
        return events.crossJoin(F.broadcast(end.select(F.coalesce("_end", F.lit(2**63 - 1)).alias("_end")))).where(f"{TS} <= _end").drop("_end")  # one row
    return events.join(end, list(keys), "left").where(f"_end is null or {TS} <= _end").drop("_end")


def write_text(events: DataFrame, path: str, raw: Iterable[str] = ()) -> None:
    """A text trace in order of time, in range-partitioned files."""
    rendered(events, raw).orderBy(TS, "stream").select("line").write.text(path)


def flattened(timeline: Timeline, types: dict[str, t.Type]) -> DataFrame:
    """The input as events again: ranges and CSV rows expanded, in order of time."""
    cells = F.array(*(F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("stream"), scalars.FUNCTIONS_SHOW(F.col(n), k, False).alias("value"))) for n, k in types.items()))
    return timeline.df.select(*timeline.keys, TS, F.explode(F.array_compact(cells)).alias("e")).select(*timeline.keys, TS, "e.*").orderBy(TS, "stream")
