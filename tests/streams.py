"""Random keyed traces, and the stepper's answers in the shape of the lowered DataFrames."""

from __future__ import annotations

import random

from pyspark.sql import types as T

from tideline.functions.expr import Fault
from tideline.functions.types import BOOL, INT, STRING, UNIT, decode, show
from tideline.operators import graph as g
from tideline.operators.stepper import Stepper
from tideline.operators.timeline import Timeline

INPUTS = {"x": INT, "y": INT, "b": BOOL, "c": BOOL, "u": UNIT, "s": STRING}


def inputs() -> dict[str, g.Input]:
    return {n: g.Input(n, t) for n, t in INPUTS.items()}


def traces(seed: int, keys: int = 3, ticks: int = 14, positive: bool = False) -> list[dict]:
    """Rows (k, ts, x, y, b, c, u, s), at random ticks of which some are 0."""
    r = random.Random(seed)
    rows = []
    for k in range(keys):
        for ts in sorted(r.sample(range(0, 40), ticks)):
            row = {"k": k, "ts": ts}
            row["x"] = r.choice([None, r.randint(1, 5) if positive else r.randint(-3, 5)])
            row["y"] = r.choice([None, None, r.randint(1, 6) if positive else r.randint(0, 4)])
            row["b"] = r.choice([None, True, False])
            row["c"] = r.choice([None, True, False])
            row["u"] = r.choice([None, None, True])
            row["s"] = r.choice([None, "a", "b", "c d"])
            rows.append(row)
    return rows


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("ts", T.LongType()), *(T.StructField(n, t.spark) for n, t in INPUTS.items())])


def timeline(spark, rows: list[dict], keys: tuple[str, ...] = ("k",), split: bool = False) -> Timeline:
    return Timeline(spark.createDataFrame(rows, SCHEMA), keys, split)


def expected(outputs: dict[str, g.Stream], ins: dict[str, g.Input], rows: list[dict]) -> set[tuple]:
    """(key, ts, stream, value) of all output events."""
    out = set()
    for k in {r["k"] for r in rows}:
        stepper = Stepper(outputs.values())
        ticks = [(r["ts"], {ins[n].id: decode(r[n], t) for n, t in INPUTS.items() if r[n] is not None}) for r in rows if r["k"] == k]
        for ts, values in stepper.run(ticks):
            for n, s in outputs.items():
                i = g.resolve(s).id
                if i in values:
                    assert not isinstance(values[i], Fault), values[i]
                    out.add((k, ts, n, show(values[i])))
    return out
