"""Queries over the ``events`` table by specifications as text, by traces, and by Structured Streaming, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline import shared_folder
from tideline.functions.types import INT, STRING
from tideline.operators import library as L
from tideline.operators.lowering import events as trace_of
from tideline.operators.lowering import outputs
from tideline.operators.timeline import TS, Timeline
from tideline.plans.event_queries import _BASE, HOUR, Query, micros, strict, upto, user_timelines
from tideline.plans.spec import compile_spec
from tideline.sources import trace
from tideline.streaming.runner import evaluate

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _named(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def specified(name: str, text: str, sql: str, time_unit: str | None = None, **options) -> None:
    """A specification over each user's timeline; ``sql`` continues the common table expressions ``e`` and ``s``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return outputs(compile_spec(text, time_unit, **options).outputs, user_timelines(spark, sf_dir))

    _QUERIES[name], _SQL[name] = run, _BASE + sql


specified(
    "spec_recursive_macro",
    """
    def nth[T](s: Events[T], n: Int): Events[T] = static if n == 0 then s else last(nth(s, n - 1), s)
    def counted[T](s: Events[T]): Events[Int] = n where {
      def n: Events[Int] = default(last(n, s) + 1, 0)
    }
    in cents: Events[Int]
    in kind: Events[String]
    out nth(cents, 3) as third
    out counted(kind) as n
    """,
    ", t as (select user_id, ts, lag(cents, 3) over (partition by user_id order by ts) as third, row_number() over (partition by user_id order by ts) as n from s) select * from t union all select distinct user_id, 0, null, 0 from s",
)
specified(
    "spec_modules_and_objects",
    """
    type Pair[T] = {left: T, right: T}
    module Money {
      def scale = 100
      def whole(n: Int) = n / scale
    }
    def swap[A](p: (A, A)): (A, A) = (p._2, p._1)
    @liftable def apart(p: (Int, Int)): Int = p._1 - p._2
    in cents: Events[Int]
    in number: Events[Int]
    def both = {left = cents, right = Money.whole(cents)}
    out both.right as units
    out both.left - both.right * Money.scale as rest
    out apart(swap((cents, number))) as apart
    """,
    " select user_id, ts, cents // 100 as units, cents % 100 as rest, number - cents as apart from s",
)
specified(
    "spec_text",
    r"""
    in cents: Events[Int]
    in kind: Events[String]
    out "$kind: ${cents + 1} cents" as shown
    out f"$cents%06d|${intToFloat(cents) /. 4.0}%.2f" as padded
    """,
    """ select user_id, ts, kind || ': ' || (cents + 1) || ' cents' as shown, lpad(cents::varchar, 6, '0') || '|' || printf('%.2f', cents / 4.0::double) as padded from s""",
)
specified(
    "spec_functions",
    """
    @liftable def mix(a: Int, b: Int) = a * 10 + b
    def twice(f: (Int) => Int, n: Int) = f(f(n))
    in click: Events[Int]
    in view: Events[Int]
    in cents: Events[Int]
    in big: Events[Bool]
    out mix(b = click, a = view) as mixed
    out lift(click, view, (a: Option[Int], b: Option[Int]) => if isSome(a) then a else b) as either
    out fold(cents, 0, (acc: Int, v: Int) => max(acc, v)) as top
    out reduce(cents, min) as low
    out slift(cents, click, (a: Int, b: Int) => a - b) as apart
    out if big then 1 else 0 as flag
    """,
    f""", m as (select *, {upto('click')} as lc, {upto('view')} as lv, {upto('cents', 'max')} as hi, {upto('cents', 'min')} as lo from s)
select user_id, ts, case when coalesce(click, view) is not null then lv * 10 + lc end as mixed, coalesce(click, view) as either, greatest(hi, 0) as top, lo as low, cents - lc as apart, big::bigint as flag from m
union all select distinct user_id, 0, null::bigint, null::bigint, 0, null::bigint, null::bigint, null::bigint from s""",
)
specified(
    "spec_out_all",
    "in click: Events[Int]\nin view: Events[Int]\ndef sum_ = click + view\nout *",
    f""", m as (select *, {upto('click')} as a, {upto('view')} as b from s) select user_id, ts, click, view, case when coalesce(click, view) is not null then a + b end as sum_ from m where coalesce(click, view) is not null""",
)
specified(
    "spec_errors_are_values",
    """
    in cents: Events[Int]
    in number: Events[Int]
    def a = number % 3
    out if a == 0 then -1 else cents / a as safe
    out const(1, cents / a) as always
    out a != 0 && cents / a > 1000 as guarded
    """,
    " select user_id, ts, case when number % 3 = 0 then -1 else cents // (number % 3) end as safe, 1::bigint as always, number % 3 <> 0 and cents // nullif(number % 3, 0) > 1000 as guarded from s",
)
specified(
    "spec_durations",
    "in click: Events[Int]\nout delay(const(1h, click), click) as fired\nout time(click) + 2ms as later",
    f""", h as (select user_id, max(ts) as h from s group by user_id), d as (select user_id, ts + {HOUR} as ts, lead(ts) over (partition by user_id order by ts) as nxt from s where click is not null),
f as (select d.user_id, d.ts from d join h using (user_id) where d.ts <= h and (nxt is null or d.ts <= nxt)), c as (select user_id, ts from s where click is not null)
select user_id, ts, case when f.user_id is not null then true end as fired, case when c.user_id is not null then ts + 2000 end as later from f full join c using (user_id, ts)""",
    "us",
)
specified(
    "spec_raw_and_blocks",
    """
    in cents: Events[Int]
    in kind: Events[String]
    def turned(a: Events[Int]) = {
      def b = -a
      return b * 2
    }
    @raw out turned(cents) as t
    out Set.size(Set.add(Set.add(Set.empty[Int], cents % 2), 1)) as odd
    out Map.get(Map.add(Map.empty[String, Int], kind, cents), kind) as got
    out List.size(List.append(List.empty[Int], cents)) as one
    """,
    " select user_id, ts, -2 * cents as t, (2 - cents % 2)::bigint as odd, cents as got, 1::bigint as one from s",
)
specified(
    "spec_own_operator",
    "in cents: Events[Int]\nout spread(cents, 500) as spread",
    f""", m as (select user_id, ts, {upto('cents', 'max')} as hi, {upto('cents', 'min')} as lo from s) select user_id, ts, greatest(hi, 500) - least(lo, 500) as spread from m union all select distinct user_id, 0, 0 from s""",
    builtins={"spread": lambda a, b: L.maximum(L.merge(a, b)) - L.minimum(L.merge(a, b))},
)


def _times(df: DataFrame) -> DataFrame:
    """user_id, ts (as in ``user_timelines``), kind and cents of all events."""
    return df.select("user_id", micros("ts").alias(TS), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def _trace(spark: SparkSession, sf_dir: str, line: str, header: str | None = None) -> str:
    """The table written as one trace file, as a trace is ordered by time from line to line; the lines of one time by their text."""
    path = f"{shared_folder(spark)}/tideline-trace-{uuid.uuid4().hex}"
    rows = _times(spark.read.parquet(f"{sf_dir}/events.parquet")).select(TS, F.expr(line).alias("line"))
    if header is not None:
        rows = rows.unionByName(spark.createDataFrame([(-1, header)], rows.schema))
    rows.coalesce(1).sortWithinPartitions(TS, "line").select("line").write.text(path)
    return path


_INT_LINE = "concat(ts, ': ', kind, ' = ', cents)"
_ONE = f"""with s as (select epoch_us(ts) - 1704067200000000 as ts, event_type as kind, cast(round("value" * 100) as bigint) as cents from events)"""


@_named
def text_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text trace read back: counts of clicks and the purchase before, over one timeline without key.

    Users' events may share their time. Each is a tick, but the clicks of one time count together, as in the SQL.
    """
    spec = compile_spec("in click: Events[Int]\nin purchase: Events[Int]\nout count(click) as clicks\nout prev(purchase) as before")
    found = outputs(spec.outputs, trace.read_text(spark, _trace(spark, sf_dir, _INT_LINE), {n: s.type for n, s in spec.inputs.items()}, repeated=True))
    together = F.max("clicks").over(Window.partitionBy(TS, F.col("clicks") > 0))  # the count of 0 at tick 0 stays
    return found.withColumn("clicks", F.when(F.col("clicks").isNotNull(), together))


_SQL["text_trace"] = f"""{_ONE}, m as (select ts, case when kind = 'click' then count(*) filter (kind = 'click') over (order by ts) end as clicks,
  case when kind = 'purchase' then lag(cents) over (partition by kind order by ts) end as "before" from s)
select * from m where clicks is not null or "before" is not null union all select 0, 0, null"""


@_named
def csv_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV trace with an expression in a cell and empty cells."""
    line = """concat(ts, ',', if(kind = 'click', concat(cents, ' + 1'), ''), ',"', kind, '"')"""
    return trace.read_csv(spark, _trace(spark, sf_dir, line, "time,x,kind"), {"x": INT, "kind": STRING}, repeated=True).df.select(TS, "x", "kind")


_SQL["csv_trace"] = f"{_ONE} select ts, case when kind = 'click' then cents + 1 end as x, kind from s"


def _ranges(spark: SparkSession, sf_dir: str, line: str) -> Timeline:
    """A trace of one line for each nation, in the order of its key."""
    path = f"{shared_folder(spark)}/tideline-trace-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).sortWithinPartitions("n_nationkey").select(F.expr(line).alias("line")).write.text(path)
    return trace.read_text(spark, path, {"x": INT, "y": INT}, until=30_000)


@_named
def trace_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of times with values that depend on the time: every line holds for 7 times of a nation's hundred."""
    even = "concat(n_nationkey * 100, ' <= t < ', n_nationkey * 100 + 7, ': x = if t % 2 == 0 then t * t else -t')"
    odd = "concat(n_nationkey * 100, ',', n_nationkey * 100 + 10, '..', n_nationkey * 100 + 60, ': y = ', n_regionkey, ' * 3')"
    line = f"if(n_nationkey % 2 = 0, {even}, {odd})"
    return _ranges(spark, sf_dir, line).df


_SQL["trace_ranges"] = """with n as (select n_nationkey::bigint * 100 as a, n_nationkey::bigint as k, n_regionkey::bigint as r from nation)
select ts, case when ts % 2 = 0 then ts * ts else -ts end as x, null::bigint as y from (select unnest(range(a, a + 7)) as ts from n where k % 2 = 0)
union all select ts, null, r * 3 from (select unnest(range(a, a + 61, 10)) as ts, r from n where k % 2 = 1)"""


@_named
def trace_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range without an end goes up to ``until``."""
    line = "if(n_nationkey = 24, '29990..: x = 1', concat(n_nationkey * 100, ': y = 2'))"
    return _ranges(spark, sf_dir, line).df


_SQL["trace_open_range"] = "select unnest(range(29990, 30001)) as ts, 1::bigint as x, null::bigint as y union all select n_nationkey * 100, null, 2 from nation where n_nationkey < 24"


@_named
def trace_abort_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event and n more."""
    return trace.read_text(spark, _trace(spark, sf_dir, _INT_LINE), {"click": INT, "view": INT}, abort_at=40, repeated=True).df.select(TS, "click", "view")


_SQL["trace_abort_at"] = f"{_ONE} select ts, case when kind = 'click' then cents end as click, case when kind = 'view' then cents end as view from (select * from s order by ts limit 41)"


@_named
def trace_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input as events again, as text."""
    types = {"click": INT, "signup": INT}
    return trace.flattened(trace.read_text(spark, _trace(spark, sf_dir, _INT_LINE), types, repeated=True), types)


_SQL["trace_flattened"] = f"""{_ONE} select ts, kind as stream, cents::varchar as "value" from s where kind in ('click', 'signup')"""


@_named
def trace_stop_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's output up to the first error, as lines; ``kind`` is raw."""
    spec = compile_spec("in error: Events[Int]\nin kind: Events[String]\nin cents: Events[Int]\n@raw out kind as kind\nout sum(cents) as total\nout error as bad")
    found = trace.stop_on(trace_of(spec.outputs, user_timelines(spark, sf_dir)), "bad", ("user_id",))
    return trace.rendered(found, spec.raw).select("user_id", TS, "stream", "line")


_SQL["trace_stop_on"] = _BASE + f""", m as (select *, {upto('cents', 'sum')}::bigint as total from s), z as (select user_id, min(ts) as stop from s where error is not null group by all),
o as (select user_id, ts, 'kind' as stream, kind as line from s union all select user_id, ts, 'total', ts || ': total = ' || total from m
  union all select user_id, ts, 'bad', ts || ': bad = ' || error from s where error is not null union all select distinct user_id, 0, 'total', '0: total = 0' from s)
select o.* from o left join z using (user_id) where stop is null or ts <= stop"""


@_named
def json_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with a key, and members of nested records by path."""
    path = f"{shared_folder(spark)}/tideline-trace-{uuid.uuid4().hex}"
    _times(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.to_json(F.struct(TS, F.col("kind").alias("k"), F.to_json(F.struct(F.struct(F.col("cents").alias("n"), F.col("kind").alias("s")).alias("a"))).alias("record"))).alias("line")).write.text(path)
    spec = compile_spec('in record: Events[String]\nout CTF.getInt(record, "a.n") as n\nout CTF.getString(record, "a.s") as s')
    return outputs(spec.outputs, trace.read_json(spark, path, {"record": STRING}, ("k",), repeated=True))


_SQL["json_trace"] = f"{_ONE} select kind as k, ts, cents as n, kind as s from s"


@_named
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification over the table as a stream (Structured Streaming, event time, watermark): what came out by the time the source was read."""
    spec = compile_spec("in cents: Events[Int]\nin click: Events[Int]\nout sum(cents) as total\nout last(click, cents) as click_before")
    # a pattern, as a stream's plain path must be a folder
    df = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events[.]parquet")
    stream = _times(df).select("user_id", TS, "cents", F.when(F.col("kind") == "click", F.col("cents")).alias("click"))
    path = f"{shared_folder(spark)}/tideline-stream-{uuid.uuid4().hex}"
    out = evaluate(stream, spec, "user_id", groups=2048)  # the whole table is one batch, with events of all keys
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


_SQL["streamed_totals"] = _BASE + f""", m as (select *, {upto('cents', 'sum')}::bigint as total, {strict('click')} as c from s)
select user_id, ts, 'total' as stream, total::varchar as "value" from m union all select user_id, ts, 'click_before', c::varchar from m where c is not null union all select distinct user_id, 0, 'total', '0' from s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
