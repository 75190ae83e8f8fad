"""``python -m tideline SPEC [TRACE]``: run a specification over a trace, or look at its graph.

A trace that is a file goes through Spark; without one, lines are read from standard input and evaluated as they come.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession

from tideline.operators import graph as g
from tideline.functions.types import decode, show
from tideline.operators.lowering import events
from tideline.plans.docs import documented, markdown
from tideline.plans.spec import Spec, compile_spec
from tideline.plans.syntax import SpecError
from tideline.sources import trace
from tideline.streaming.engine import Engine, EngineError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tideline", description=__doc__)
    p.add_argument("spec")
    p.add_argument("trace", nargs="?", help="text or CSV trace, at any path that Spark can read")
    p.add_argument("--csv", action="store_true", help="the trace is CSV")
    p.add_argument("--until", type=int, help="where open ranges end")
    p.add_argument("--abort-at", type=int, metavar="N", help="stop after N more events than the first")
    p.add_argument("--stop-on", metavar="STREAM", help="stop at the first event of this output")
    p.add_argument("--time-unit", metavar="UNIT", help="the unit of timestamps, for durations like 5ms")
    p.add_argument("--flatten-input", action="store_true", help="print the trace with ranges expanded")
    p.add_argument("--verify-only", action="store_true", help="only compile")
    p.add_argument("--print-core", action="store_true", help="print the core graph")
    p.add_argument("--list-in-streams", action="store_true")
    p.add_argument("--list-out-streams", action="store_true")
    p.add_argument("--depth", action="store_true", help="print the longest propagation path")
    p.add_argument("--recursion", action="store_true", help="print the size of the largest recursion")
    p.add_argument("--doc", action="store_true", help="print what the specification defines and how it is described, as Markdown")
    p.add_argument("--node-count", action="store_true", help="print the number of nodes")
    a = p.parse_args(argv)
    try:
        with open(a.spec, encoding="utf-8") as f:
            text = f.read()
        if a.doc:
            print(markdown(documented(text)))
            return 0
        spec = compile_spec(text, a.time_unit, os.path.dirname(os.path.abspath(a.spec)))
    except SpecError as error:
        print(error, file=sys.stderr)
        return 1
    outs = list(spec.outputs.values())
    looks = {
        "print_core": lambda: g.describe(spec.outputs),
        "list_in_streams": lambda: "\n".join(spec.inputs),
        "list_out_streams": lambda: "\n".join(spec.outputs),
        "depth": lambda: g.depth(outs),
        "recursion": lambda: g.recursive_depth(outs),
        "node_count": lambda: g.node_count(outs),
    }
    asked = [f for n, f in looks.items() if getattr(a, n)]
    for look in asked:
        print(look())
    if asked or a.verify_only:
        return 0
    if a.trace is None:
        return online(spec, sys.stdin, a)
    spark = SparkSession.builder.appName("tideline").getOrCreate()
    types = {n: s.type for n, s in spec.inputs.items()}
    line = (trace.read_csv if a.csv else trace.read_text)(spark, a.trace, types, a.until, a.abort_at)
    found = trace.flattened(line, types) if a.flatten_input else events(spec.outputs, line)
    if a.stop_on:
        found = trace.stop_on(found, a.stop_on)
    for row in trace.rendered(found, spec.raw).orderBy("ts", "stream").select("line").toLocalIterator():
        print(row["line"])
    return 0


def online(spec: Spec, lines: Iterable[str], a: argparse.Namespace) -> int:
    """Evaluate lines as they come and print each output event once time has moved past it."""
    types = {n: s.type for n, s in spec.inputs.items()}
    stopped, last = False, -1

    def tell(ts: int, name: str, value: Any) -> None:
        nonlocal last, stopped
        if stopped and ts > last:
            raise StopIteration
        last, stopped = ts, stopped or name == a.stop_on
        print(show(value) if name in spec.raw else f"{ts}: {name} = {show(value)}", flush=True)

    engine = Engine(spec, tell)
    try:
        for n, (ts, stream, value) in enumerate(trace.events_of_lines(lines, types, a.until, a.csv)):
            if a.abort_at is not None and n > a.abort_at:
                break
            if a.flatten_input:
                print(f"{ts}: {stream} = {show(decode(value, types[stream]))}" if stream in types else ts, flush=True)
                continue
            engine.set_time(ts)
            if stream in types:
                engine.provide(stream, decode(value, types[stream]))
        if not a.flatten_input:
            engine.step(0)
    except StopIteration:
        pass
    except (EngineError, trace.TraceError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
