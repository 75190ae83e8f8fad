"""Timelines: one row per key and tick, one nullable column per stream; and running values over them.

A tick is an instant at which any stream of the key has an event; time is a long. Streams of one
timeline run independently for each key. Without key columns the whole table is one timeline.

Where times repeat in a table, ``order`` names columns that put the rows of one time in order: each is a tick
of its own, and ticks that aren't in the table come before them.

Running values (last, count, sum, max, min) come from window functions that Spark hash-partitions by key:
all streams share one shuffle and one sort. That leaves a key's ticks in one task. A ``split`` timeline
instead range-partitions by (key, ts), computes inside each range and carries each range's totals to
the later ranges of its key, so that neither a hot key nor a timeline without key is one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import shared_folder

TS = "ts"
_RANGE = "_range"
_WHOLE = "_whole"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that driver and executors share; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tideline-timeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Running:
    """A running value of ``value``: up to and including this tick, or strictly before it."""

    kind: str
    value: Column
    strict: bool = False


_LOCAL: dict[str, Callable] = {"last": lambda c: F.last(c, ignorenulls=True), "count": F.count, "sum": F.sum, "max": F.max, "min": F.min}
_JOIN: dict[str, Callable] = {
    "last": lambda own, before: F.coalesce(own, before),
    "count": lambda own, before: own + F.coalesce(before, F.lit(0).cast("long")),
    "sum": lambda own, before: F.when(own.isNull(), before).when(before.isNull(), own).otherwise(own + before),
    "max": lambda own, before: F.greatest(own, before),
    "min": lambda own, before: F.least(own, before),
}


@dataclass(frozen=True)
class Timeline:
    """``df`` has the key columns, ``ts`` (long), the columns of ``order`` (long, from 0) and stream columns; (key, ts, order) is unique."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    split: bool = False
    inputs: dict[str, Column] = field(default_factory=dict)
    order: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.keys and not self.split:
            object.__setattr__(self, "split", True)

    def with_df(self, df: DataFrame) -> Timeline:
        return replace(self, df=df)

    def zero(self) -> Column:
        """Whether a row is tick 0; where times repeat, that is not one of the table's rows."""
        return reduce(lambda a, b: a & b, (F.col(o) < 0 for o in self.order), F.col(TS) == 0)

    def running(self, values: dict[str, Running]) -> Timeline:
        """The timeline with a column for each running value."""
        if not values:
            return self
        if not self.split:
            return self.with_df(self.df.withColumns({n: _over(r, list(self.keys), self.order) for n, r in values.items()}))
        return self._carried(values)

    def _carried(self, values: dict[str, Running]) -> Timeline:
        n = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        keys = [*self.keys, _RANGE]
        ranged = written(self.df.withColumns({f"_in_{n_}": r.value for n_, r in values.items()}).repartitionByRange(n, *self.keys, TS, *self.order).withColumn(_RANGE, F.spark_partition_id()))
        local = ranged.withColumns({n_: _over(replace(r, value=F.col(f"_in_{n_}")), keys, self.order) for n_, r in values.items()})
        order = F.struct(TS, *self.order)
        totals = ranged.groupBy(*keys).agg(*(_total(r.kind, F.col(f"_in_{n_}"), order).alias(n_) for n_, r in values.items()))
        earlier = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
        # one row for each key and range that holds some of it
        carry = totals.select(*(F.col(k).alias(f"_c_{k}") for k in keys), *(_LOCAL["sum" if r.kind == "count" else r.kind](F.col(n_)).over(earlier).alias(f"_c_{n_}") for n_, r in values.items()))
        joined = local.join(carry, reduce(lambda a, b: a & b, (local[k].eqNullSafe(carry[f"_c_{k}"]) for k in keys)))
        out = [*self.df.columns, *(_JOIN[r.kind](F.col(n_), F.col(f"_c_{n_}")).alias(n_) for n_, r in values.items())]
        return self.with_df(joined.select(*out))


def _over(r: Running, keys: list[str], order: tuple[str, ...]) -> Column:
    w = Window.partitionBy(*keys).orderBy(TS, *order).rowsBetween(Window.unboundedPreceding, -1 if r.strict else 0)
    return _LOCAL[r.kind](r.value).over(w)


def _total(kind: str, value: Column, order: Column) -> Column:
    """A range's total; the last value is the one with the greatest time that has an event."""
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return _LOCAL[kind](value)


def from_events(df: DataFrame, streams: dict[str, Column], keys: tuple[str, ...] = (), ts: str | Column = TS, unique: bool = False, split: bool = False, order: tuple[str, ...] = ()) -> Timeline:
    """A timeline from rows of events: ``streams`` gives each stream's value in a row, null where it has no event.

    Two events of one stream at the same key and tick are an error, raised when the result is computed;
    ``unique`` says that (key, ts) is unique, which saves the check and its shuffle. With ``order`` each row is a tick of its own.
    """
    at = F.col(ts) if isinstance(ts, str) else ts
    rows = df.select(*keys, at.cast("long").alias(TS), *order, *(c.alias(n) for n, c in streams.items()))
    if not unique and not order:
        once = lambda n: F.when(F.count(n) > 1, F.raise_error(F.lit(f"two events of {n} at the same time"))).otherwise(F.first(n, ignorenulls=True))
        if keys and not split:
            rows = rows.repartition(*keys)  # serves this grouping and the windows after it
        rows = rows.groupBy(*keys, TS).agg(*(once(n).alias(n) for n in streams)) if streams else rows.distinct()
    return Timeline(rows, tuple(keys), split, order=tuple(order))


def from_long(df: DataFrame, types: dict[str, str], keys: tuple[str, ...] = (), split: bool = False) -> Timeline:
    """A timeline from rows (keys, ts, stream, value); ``types`` gives the Spark type that each declared stream's value is cast to.

    Events of undeclared streams make ticks only.
    """
    return from_events(df, {n: F.when(F.col("stream") == n, F.col("value").cast(t)) for n, t in types.items()}, keys, split=split)


def union_ticks(timeline: Timeline, more: DataFrame) -> Timeline:
    """The timeline with the rows of ``more`` (some of its columns): equal ticks become one row, by the first value of each column."""
    both = timeline.df.unionByName(more.withColumns({o: F.lit(-1).cast("long") for o in timeline.order}), allowMissingColumns=True)
    if timeline.keys and not timeline.split:
        both = both.repartition(*timeline.keys)  # serves this grouping and all windows after it
    tick = [*timeline.keys, TS, *timeline.order]
    rest = [c for c in both.columns if c not in tick]
    if not rest:
        return timeline.with_df(both.distinct())
    return timeline.with_df(both.groupBy(*tick).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest)))


def horizon(timeline: Timeline) -> DataFrame:
    """Each key's last input tick; without keys one row, whatever the table holds."""
    return timeline.df.groupBy(*timeline.keys).agg(F.max(TS).alias("_horizon"))


def with_zero(timeline: Timeline) -> Timeline:
    """The timeline with tick 0 for every key; without keys also for an empty table."""
    if timeline.keys:
        zero = timeline.df.select(*timeline.keys).distinct().withColumn(TS, F.lit(0).cast("long"))
    else:
        zero = timeline.df.sparkSession.range(1).select(F.lit(0).cast("long").alias(TS))
    return union_ticks(timeline, zero)
