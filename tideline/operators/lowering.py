"""Streams to DataFrames: the graph's nodes become columns of the timeline, stage by stage.

Row-local nodes are projections; ``last``, ``on``, signal lifts and running folds are running values (one
window or carried range for all nodes that are ready at the same time). Periods and delays whose every
reset brings its own delay make ticks by ``sequence`` and a look at the next reset. What is left
(recursions without closed form, other folds and delays) goes through the stepper: rows hash-partitioned
by key and sorted by time stream through ``mapInArrow``, whose state is one key's operators.

A stream that can fail has the column ``struct<v, e>``: value and error. Errors are raised by ``outputs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline import find_package
from tideline.functions.expr import Env, Fault, column, literal
from tideline.functions.scalars import FUNCTIONS_SHOW
from tideline.functions.types import Type, decode, encode
from tideline.operators import graph as g
from tideline.operators.stepper import Stepper
from tideline.operators.timeline import TS, Running, Timeline, horizon, union_ticks, with_zero

_FIRED = "_fired"


@dataclass
class Cell:
    """A stream at a row: whether it has an event, its value, its error (None: can't fail)."""

    present: Column
    value: Column
    error: Column | None = None


def _name(s: g.Stream) -> str:
    return f"s{s.id}"


def cell(c: Column, fallible: bool) -> Cell:
    if fallible:
        return Cell(c.isNotNull(), c["v"], c["e"])
    return Cell(c.isNotNull(), c)


def event(present: Column, value: Column, error: Column | None, fallible: bool, t: Type) -> Column:
    """The column of a stream: null without event."""
    if not fallible:
        return F.when(present, value.cast(t.spark) if t.name != "Any" else value)
    error = F.lit(None).cast("string") if error is None else error.cast("string")
    return F.when(present, F.struct(F.when(error.isNull(), value.cast(t.spark) if t.name != "Any" else value).alias("v"), error.alias("e")))


class Lowering:
    def __init__(self, outputs: list[g.Stream], timeline: Timeline) -> None:
        find_package(timeline.df.sparkSession)
        self.outputs = [g.resolve(s) for s in outputs]
        self.fallible: dict[int, bool] = {}
        self.inputs = [s for s in g.reachable(self.outputs) if isinstance(s, g.Input)]
        for s in self.inputs:
            if s.name not in timeline.df.columns:
                raise KeyError(f"no input stream {s.name}")
        self.timeline = timeline.with_df(timeline.df.select(*timeline.keys, TS, *timeline.order, *(F.col(s.name).alias(_name(s)) for s in self.inputs)))
        self.done: set[int] = set()

    def run(self) -> Timeline:
        parts = g.components(self.outputs)
        for part in parts:
            for s in part:
                self.fallible[s.id] = g.is_recursive(part) and not isinstance(s, g.Delay | g.Time | g.Const) or self._can_fail(s)
        g.within_tick([s for p in parts for s in p])  # cycles that no tick could evaluate
        if any(isinstance(s, g.Default | g.Fold | g.Period | g.Collected) for p in parts for s in p):
            self.timeline = with_zero(self.timeline)
        self.done |= {s.id for s in self.inputs}
        self.last_input = horizon(self.timeline)
        waiting = [p for p in parts if not all(s.id in self.done for s in p)]
        while waiting:
            ready = [p for p in waiting if all(g.resolve(d).id in self.done or any(g.resolve(d) is x for x in p) for s in p for d in s.deps)]
            simple = [p[0] for p in ready if self._simple(p)]
            if simple:
                self._stage(simple)
                taken = simple
            else:
                taken = ready[0]
                if self.timeline.order and not isinstance(taken[0], g.Period):
                    raise ValueError("delays, collections and recursions need times that don't repeat")
                if not g.is_recursive(taken) and isinstance(taken[0], g.Period):
                    self._period(taken[0])
                elif not g.is_recursive(taken) and isinstance(taken[0], g.Delay) and self._own_delays(taken[0]):
                    self._delay(taken[0])
                elif self._by_windows(taken):
                    self._collected(taken[0])
                else:
                    # all steps that are ready go in one pass, unless they make ticks that others must see
                    taken = [s for p in ready if not (isinstance(p[0], g.Period) or self._by_windows(p) or len(p) == 1 and isinstance(p[0], g.Delay) and not g.is_recursive(p) and self._own_delays(p[0])) for s in p]
                    self._stepped(taken)
            self.done |= {s.id for s in taken}
            waiting = [p for p in waiting if p[0].id not in self.done]
        return self.timeline

    def _can_fail(self, s: g.Stream) -> bool:
        of = lambda d: self.fallible.get(g.resolve(d).id, False)
        if isinstance(s, g.Input | g.Nil | g.Time | g.Delay | g.Period | g.Const):
            return False
        if isinstance(s, g.Last):
            return of(s.deps[0])
        if isinstance(s, g.On):
            return of(s.deps[1])
        if isinstance(s, g.Lift | g.SignalLift):
            return g.can_fail(s.body, [of(d) for d in s.deps])
        if isinstance(s, g.Fold):
            return not self._closed(s) and g.can_fail(s.body, [False, of(s.deps[0])])
        return any(map(of, s.deps))

    def _closed(self, s: g.Stream) -> bool:
        """A fold that is a running aggregate; a total that may fail isn't."""
        return isinstance(s, g.Fold) and s.shape is not None and not (self.fallible.get(g.resolve(s.deps[0]).id, False) and s.shape != "count")

    def _simple(self, part: list[g.Stream]) -> bool:
        s = part[0]
        return not g.is_recursive(part) and not isinstance(s, g.Delay | g.Period | g.Collected) and (not isinstance(s, g.Fold) or self._closed(s))

    def _cell(self, s: g.Stream) -> Cell:
        s = g.resolve(s)
        return cell(F.col(_name(s)), self.fallible[s.id])

    def _stage(self, nodes: list[g.Stream]) -> None:
        """Columns of nodes whose dependencies are columns: first their running values, then a projection."""
        running: dict[str, Running] = {}
        out: dict[str, Column] = {}

        def last(s: g.Stream, strict: bool) -> Column:
            s = g.resolve(s)
            name = f"{'p' if strict else 'c'}{s.id}"
            running[name] = Running("last", F.col(_name(s)), strict)
            return F.col(name)

        for s in nodes:
            out[_name(s)] = self._column(s, last, running)
        if running:
            before = self.timeline.df.columns
            self.timeline = self.timeline.running(running)
            self.timeline = self.timeline.with_df(self.timeline.df.select(*before, *(c.alias(n) for n, c in out.items())))
        else:
            self.timeline = self.timeline.with_df(self.timeline.df.withColumns(out))

    def _column(self, s: g.Stream, last, running: dict[str, Running]) -> Column:
        fallible = self.fallible[s.id]
        cells = [self._cell(d) for d in s.deps]
        zero = self.timeline.zero()
        if isinstance(s, g.Nil):
            return F.lit(None).cast(s.type.spark)
        if isinstance(s, g.Time):
            return F.when(cells[0].present, F.col(TS))
        if isinstance(s, g.Const):
            return F.when(cells[0].present, literal(s.value.value, s.type))
        if isinstance(s, g.Default):
            return F.coalesce(self._as(s, s.deps[0]), event(zero, literal(s.value.value, s.type), None, fallible, s.type))
        if isinstance(s, g.Merge):
            return F.coalesce(*(self._as(s, d) for d in s.deps))
        if isinstance(s, g.Last):
            return F.when(cells[1].present, last(s.deps[0], True))
        if isinstance(s, g.On):
            return F.when(cells[0].present, last(s.deps[1], False))
        if isinstance(s, g.DefaultFrom):
            v, d = self._as(s, s.deps[0]), self._as(s, s.deps[1])
            running[f"d{s.id}"] = Running("count", F.coalesce(v, d), True)
            return F.coalesce(v, F.when(F.col(f"d{s.id}") == 0, d))
        if isinstance(s, g.Fold):
            return self._fold(s, running)
        if isinstance(s, g.Lift):
            env = {i: (c.present, c.value, c.error) for i, c in enumerate(cells)}
            any_ = _any([c.present for c in cells])
            return self._lifted(s, env, any_)
        assert isinstance(s, g.SignalLift)
        if len(s.deps) == 1:
            now = cells
            fires = cells[0].present
        else:
            now = [cell(last(d, False), self.fallible[g.resolve(d).id]) for d in s.deps]
            fires = _any([c.present for c in cells])
            for c in now:
                fires = fires & c.present
        value, error = column(s.body, {i: (c.present, c.value, c.error) for i, c in enumerate(now)})
        return event(fires, value, error, fallible, s.type)

    def _lifted(self, s: g.Lift, env: Env, any_: Column) -> Column:
        value, error = column(s.body, env)
        fallible = self.fallible[s.id]
        some = value["some"] if error is None else error.isNotNull() | value["some"]
        return event(any_ & some, value["v"], error, fallible, s.type)

    def _as(self, s: g.Stream, d: g.Stream) -> Column:
        """The dependency's column in the shape of ``s``'s."""
        d = g.resolve(d)
        c = F.col(_name(d))
        if self.fallible[s.id] and not self.fallible[d.id]:
            return event(c.isNotNull(), c, None, True, s.type)
        if d.type != s.type and s.type.name != "Any":
            return c.cast(s.type.spark) if not self.fallible[d.id] else event(c.isNotNull(), c["v"], c["e"], True, s.type)
        return c

    def _fold(self, s: g.Fold, running: dict[str, Running]) -> Column:
        d = g.resolve(s.deps[0])
        c = self._cell(d)
        name = f"f{s.id}"
        running[name] = Running(s.shape, c.value if s.shape != "count" else F.col(_name(d)), False)
        if s.init is None:
            return F.when(c.present, F.col(name))
        init = literal(s.init.value, s.type)
        total = F.coalesce(F.col(name), F.lit(0).cast("long")) + init if s.shape in ("count", "sum") else {"max": F.greatest, "min": F.least}[s.shape](F.col(name), init)
        return F.when(c.present | self.timeline.zero(), total)

    def _period(self, s: g.Period) -> None:
        ticks = self.last_input.select(*self.timeline.keys, F.explode(F.expr(f"sequence(0L, _horizon, {s.every}L)")).alias(TS), F.lit(True).alias(_name(s)))
        self.timeline = union_ticks(self.timeline, ticks)

    def _own_delays(self, s: g.Delay) -> bool:
        """Whether ``delays`` only has events together with ``resets``, so that a delay never sets itself again."""
        d, r = map(g.resolve, s.deps)
        while d is not r and isinstance(d, g.Const | g.Time) or isinstance(d, g.SignalLift) and len(d.deps) == 1:
            d = g.resolve(d.deps[0])
        return d is r and not self.fallible[g.resolve(s.deps[0]).id]

    def _delay(self, s: g.Delay) -> None:
        """A delay is cut off by the next reset before its target, or by the last input."""
        d, r = self._cell(s.deps[0]), self._cell(s.deps[1])
        keys = list(self.timeline.keys)
        resets = self.timeline.df.where(r.present).select(*keys, TS, d.value.alias("_delay"))
        late = F.when(F.col("_delay") <= 0, F.raise_error(F.concat(F.lit("A delay must be positive, not "), F.col("_delay").cast("string")))).otherwise(F.col(TS) + F.col("_delay"))
        if self.timeline.split:
            # the next reset is the last one before, with time reversed
            back = Timeline(resets.withColumn(TS, -F.col(TS)), self.timeline.keys, True).running({"_next": Running("last", -F.col(TS), True)})
            resets = back.df.withColumn(TS, -F.col(TS))
        else:
            resets = resets.withColumn("_next", F.lead(TS).over(Window.partitionBy(*keys).orderBy(TS)))
        armed = resets.select(*keys, late.alias("_at"), "_next")
        if keys:
            last = self.last_input.select(*(F.col(k).alias(f"_h_{k}") for k in keys), "_horizon")
            condition = F.lit(True)
            for k in keys:
                condition = condition & armed[k].eqNullSafe(last[f"_h_{k}"])
            armed = armed.join(last, condition)
        else:
            armed = armed.crossJoin(F.broadcast(self.last_input))  # one row
        ticks = armed.where("_at <= _horizon and (_next is null or _at <= _next)").select(*keys, F.col("_at").alias(TS), F.lit(True).alias(_name(s))).distinct()
        self.timeline = union_ticks(self.timeline, ticks)

    def _by_windows(self, part: list[g.Stream]) -> bool:
        """Whether windows over one key's ticks give a collection."""
        s = part[0]
        return isinstance(s, g.Collected) and not self.timeline.split and not self.fallible[s.id] and "map<" not in g.resolve(s.deps[0]).type.spark.simpleString()

    def _collected(self, s: g.Collected) -> None:
        """A running collection. Sets and numberings are lists of first occurrences; numbers of each value are
        running values of each (tick, value), as many as the maps have entries.
        """
        keys, df = list(self.timeline.keys), self.timeline.df
        first, last = self._cell(s.deps[0]), self._cell(s.deps[-1])
        upto = Window.partitionBy(*keys).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
        zero = F.col(TS) == 0
        value = F.last(first.value, ignorenulls=True).over(upto) if len(s.deps) > 1 else first.value
        df = df.withColumns({"_x": F.when(last.present if s.kind == "count" else last.present & ~zero, value), "_n": last.value})
        some = F.col("_x").isNotNull()
        if s.kind in ("set", "counting"):
            seen = F.row_number().over(Window.partitionBy(*keys, "_x").orderBy(TS)) == 1
            df = df.withColumn("_new", F.when(some & seen, F.col("_x")))
            df = df.withColumn("_all", F.when(some | zero, F.collect_list("_new").over(upto)))
            whole = F.array_sort("_all") if s.kind == "set" else F.map_from_arrays("_all", F.transform("_all", lambda _, i: i.cast("long") + 1))
            self.timeline = self.timeline.with_df(df.withColumn(_name(s), whole.cast(s.type.spark)).drop("_x", "_n", "_new", "_all"))
            return
        values = F.collect_set("_x").over(Window.partitionBy(*keys))
        each = df.where(some).withColumn("_values", values).select(*keys, TS, "_x", "_n", F.explode("_values").alias("_value"))
        own = F.when(F.col("_x") == F.col("_value"), F.lit(1) if s.kind == "count" else F.col("_n"))
        number = {"count": F.count, "max": F.max, "min": F.min}[s.kind](own).over(Window.partitionBy(*keys, "_value").orderBy(TS).rowsBetween(Window.unboundedPreceding, 0))
        each = each.select(*keys, TS, F.when(number > 0 if s.kind == "count" else number.isNotNull(), F.struct("_value", number.alias("_number"))).alias("_entry"))
        maps = each.groupBy(*keys, TS).agg(F.map_from_entries(F.array_sort(F.collect_list("_entry"))).alias("_map"))
        maps = maps.select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.col(TS).alias("_m_ts"), "_map")
        met = F.col(TS) == F.col("_m_ts")
        for k in keys:
            met = met & df[k].eqNullSafe(maps[f"_m_{k}"])
        empty = F.map_from_arrays(F.array(), F.array()).cast(s.type.spark)
        whole = F.coalesce(F.col("_map").cast(s.type.spark), F.when(zero, empty))
        self.timeline = self.timeline.with_df(df.join(maps, met, "left").select(*self.timeline.df.columns, whole.alias(_name(s))))

    def _stepped(self, nodes: list[g.Stream]) -> None:
        """Evaluate nodes by the stepper; their other dependencies are columns already."""
        ids = {s.id for s in nodes}
        given = {g.resolve(d).id: g.resolve(d) for s in nodes for d in s.deps if g.resolve(d).id not in ids}
        keys = list(self.timeline.keys)
        before = self.timeline.df
        stepper = Stepper(nodes, given.values())
        out_types = {_name(s): (T.StructType([T.StructField("v", s.type.spark), T.StructField("e", T.StringType())]) if self.fallible[s.id] else s.type.spark) for s in nodes}
        schema = T.StructType([*before.schema.fields, *(T.StructField(n, t) for n, t in out_types.items())])
        run = _Run(stepper, to_arrow_schema(schema), keys, list(before.columns), {i: (_name(s), s.type, self.fallible[i]) for i, s in given.items()}, {s.id: (_name(s), s.type, self.fallible[s.id]) for s in nodes})
        n = int(before.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        dealt = before.repartition(n, *keys) if keys else before.coalesce(1)  # a recursion without key is one sequence
        self.timeline = self.timeline.with_df(dealt.sortWithinPartitions(*keys, TS).mapInArrow(run, schema))


class _Run:
    """The ticks of one key after the other, in batches; what timers add comes as rows of its own."""

    def __init__(self, stepper: Stepper, schema: pa.Schema, keys: list[str], columns: list[str], given: dict, out: dict) -> None:
        self.stepper, self.schema, self.keys, self.columns, self.given, self.out = stepper, schema, keys, columns, given, out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st, key, fresh = self.stepper, None, True
        for batch in batches:
            n = batch.num_rows
            keys = list(zip(*(batch.column(k).to_pylist() for k in self.keys), strict=True)) if self.keys else [()] * n
            times = batch.column(TS).to_pylist()
            given = [(i, batch.column(name).to_pylist(), t, fallible) for i, (name, t, fallible) in self.given.items()]
            # output rows: the row that each comes of (a timer's tick before it, too), whether it is that row, its time and values
            source: list[int] = []
            own_row: list[bool] = []
            at_times: list[int] = []
            out: dict[int, list] = {i: [] for i in self.out}
            for r in range(n):
                own, ts = keys[r], times[r]
                if fresh or own != key:
                    key, fresh = own, False
                    st.reset()
                for at, values in st.due(ts):
                    if any(i in values for i in out):
                        source.append(r)
                        own_row.append(False)
                        at_times.append(at)
                        self._add(out, values)
                events = {i: self._read(column[r], t, fallible) for i, column, t, fallible in given if column[r] is not None}
                source.append(r)
                own_row.append(True)
                at_times.append(ts)
                self._add(out, st.tick(ts, events))
            yield self._batch(batch, source, own_row, at_times, out)

    def _batch(self, batch: pa.RecordBatch, source: list[int], own_row: list[bool], at_times: list[int], out: dict[int, list]) -> pa.RecordBatch:
        """Columns that the operators don't read go through as they are, without becoming Python values."""
        names = {name: i for i, (name, _, _) in self.out.items()}
        whole = len(source) == batch.num_rows
        rows = None if whole else pa.array(source, pa.int64())
        kept = None if whole else pa.array([r if own else None for r, own in zip(source, own_row, strict=True)], pa.int64())
        columns = []
        for field in self.schema:
            if field.name in names:
                columns.append(pa.array(out[names[field.name]], field.type))
            elif field.name == TS and not whole:
                columns.append(pa.array(at_times, field.type))
            else:
                column = batch.column(field.name)
                column = column if whole else column.take(rows if field.name in self.keys else kept)
                columns.append(column if column.type == field.type else column.cast(field.type))
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    @staticmethod
    def _read(x, t: Type, fallible: bool):
        if not fallible:
            return decode(x, t)
        return Fault(x["e"]) if x["e"] is not None else decode(x["v"], t)

    def _add(self, out: dict[int, list], values: dict) -> None:
        for i, (_, t, fallible) in self.out.items():
            x = None
            if i in values:
                v = values[i]
                if not fallible:
                    x = encode(v, t)
                else:
                    x = {"v": None, "e": str(v)} if isinstance(v, Fault) else {"v": encode(v, t), "e": None}
            out[i].append(x)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def outputs(streams: dict[str, g.Stream], timeline: Timeline, ticks: str = "any") -> DataFrame:
    """Keys, ts and a column for each stream. ``ticks``: rows at which "any" stream has an event, or "all" ticks.

    A failed event raises when its row is computed.
    """
    low = Lowering(list(streams.values()), timeline)
    df = low.run().df
    columns = []
    present = F.lit(False)
    for n, s in streams.items():
        c = low._cell(s)
        present = present | c.present
        value = c.value if c.error is None else F.when(c.error.isNotNull(), F.raise_error(F.concat(F.lit(f"{n}: "), c.error, F.lit(" (at "), F.col(TS).cast("string"), F.lit(")")))).otherwise(c.value)
        columns.append(value.alias(n))
    if ticks == "any":
        df = df.where(present)
    return df.select(*timeline.keys, TS, *columns)


def events(streams: dict[str, g.Stream], timeline: Timeline) -> DataFrame:
    """Keys, ts, stream and value (as a trace prints it), a row for each output event."""
    low = Lowering(list(streams.values()), timeline)
    df = low.run().df
    cells = []
    for n, s in streams.items():
        c = low._cell(s)
        shown = FUNCTIONS_SHOW(c.value, g.resolve(s).type, False)
        cells.append(F.when(c.present, F.struct(F.lit(n).alias("stream"), shown.alias("value"), (F.lit(None).cast("string") if c.error is None else c.error).alias("error"))))
    long = df.select(*timeline.keys, TS, F.explode(F.array_compact(F.array(*cells))).alias("e")).select(*timeline.keys, TS, "e.*")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("stream"), F.lit(": "), F.col("error"), F.lit(" (at "), F.col(TS).cast("string"), F.lit(")")))).otherwise(F.col("value"))
    return long.select(*timeline.keys, TS, "stream", checked.alias("value"))


