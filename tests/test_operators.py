"""Every operator of the library: lowered to DataFrames against the stepper, on random keyed traces."""

import pytest

from streams import expected, inputs, timeline, traces
from tideline.functions.expr import apply
from tideline.functions.scalars import ite
from tideline.functions.types import INT
from tideline.operators import library as L
from tideline.operators.lowering import events

CORE = {
    "nil": lambda i: L.merge(L.nil(), i["x"]),
    "default": lambda i: L.default(i["x"], 7),
    "default_from": lambda i: L.default_from(i["x"], i["y"]),
    "last": lambda i: L.last(i["x"], i["y"]),
    "time": lambda i: L.time(i["u"]),
    "lift2": lambda i: L.lift(lambda a, b: ite(apply("isSome", a) & apply("isNone", b), a, b), i["x"], i["y"]),
    "lift3": lambda i: L.lift3(lambda a, b, c: apply("Some", apply("getSomeOrElse", a, 0) + apply("getSomeOrElse", b, 10) * apply("getSomeOrElse", c, 2)), i["x"], i["y"], L.time(i["u"])),
    "slift1": lambda i: L.slift1(lambda a: a * a, i["x"]),
    "slift2": lambda i: i["x"] + i["y"],
    "slift3": lambda i: L.slift3(lambda a, b, c: a * b - c, i["x"], i["y"], L.time(i["u"])),
    "slift5": lambda i: L.slift5(lambda a, b, c, d, e: ite(c & d, a, b) + e, i["x"], i["y"], i["b"], i["c"], L.time(i["s"])),
    "curried": lambda i: L.curried(lambda a, b: a - b)(i["x"], i["y"]),
    "ite": lambda i: ite(i["b"], i["x"], i["y"]),
    "literal": lambda i: 3 - i["x"],
}
FILTERS = {
    "const": lambda i: L.const(4, i["x"]),
    "first": lambda i: L.first(i["x"], i["y"]),
    "prev": lambda i: L.prev(i["x"]),
    "merge": lambda i: L.merge(i["x"], i["y"], L.time(i["u"])),
    "merge_unit": lambda i: L.merge_unit(i["x"], i["b"], i["s"]),
    "filter": lambda i: L.filter(i["x"], i["b"]),
    "pure": lambda i: L.pure(i["y"]),
    "is_first": lambda i: L.is_first(i["y"]),
    "first_event": lambda i: L.first_event(i["y"]),
    "had_any_event": lambda i: L.had_any_event(i["y"]),
    "const_if": lambda i: L.const_if("hit", i["b"]),
    "unit_if": lambda i: L.unit_if(i["b"]),
    "on": lambda i: L.on(i["x"], i["y"]),
    "rising": lambda i: L.rising(i["b"]),
    "falling": lambda i: L.falling(i["b"]),
    "sample": lambda i: L.sample(i["x"], 5),
}
AGGREGATES = {
    "fold": lambda i: L.fold(i["x"], 1, lambda a, v: a * 2 - v),
    "reduce": lambda i: L.reduce(i["x"], lambda a, v: a - v),
    "count": lambda i: L.count(i["x"]),
    "sum": lambda i: L.sum(i["x"]),
    "maximum": lambda i: L.maximum(i["x"]),
    "minimum": lambda i: L.minimum(i["x"]),
    "average": lambda i: L.average(i["x"]),
    "reset_count": lambda i: L.reset_count(i["x"], i["y"]),
    "no_event": lambda i: L.no_event(i["x"], i["y"]),
    "runtime": lambda i: L.runtime(i["x"], i["y"]),
    "bursts": lambda i: L.bursts(i["x"], 6, 3, 2),
    "bursts_since": lambda i: L.bursts_since(i["x"], 6, 3, 2, i["u"]),
    "last_n": lambda i: L.last_n(i["x"], 3),
}
COLLECTIONS = {
    "collect_count": lambda i: L.collect_count(i["s"]),
    "collect_max": lambda i: L.collect_max(i["s"], i["x"]),
    "collect_min": lambda i: L.collect_min(i["s"], i["x"]),
    "counting": lambda i: L.counting(i["s"]),
    "collect_set": lambda i: L.collect_set(i["y"]),
}
DELAYS = {
    "delay_own": lambda i: L.delay(i["x"], i["x"]),
    "delay_own_const": lambda i: L.delay(L.const(3, i["u"]), i["u"]),
    "delay_general": lambda i: L.delay(i["x"], i["y"]),
    "delay_feeds": lambda i: L.count(L.delay(L.const(4, i["u"]), i["u"])),
    "period": lambda i: L.period(6),
    "period_count": lambda i: L.reset_count(i["x"], L.period(10)),
    "recursive_delay": lambda i: L.recursive(INT, lambda me: L.merge(L.const(3, L.delay(me, i["u"])), L.const(2, i["u"]))),
}


@pytest.mark.parametrize("split", [False, True], ids=["hashed", "split"])
@pytest.mark.parametrize("group", [CORE, FILTERS, AGGREGATES, COLLECTIONS, DELAYS], ids=["core", "filters", "aggregates", "collections", "delays"])
def test_lowered_operators_agree_with_the_stepper(spark, group, split):
    for seed in (1, 2):
        ins = inputs()
        outs = {n: make(ins) for n, make in group.items()}
        rows = traces(seed, positive=group is DELAYS)
        got = {tuple(r) for r in events(outs, timeline(spark, rows, split=split)).collect()}
        want = expected(outs, ins, rows)
        for n in outs:
            assert {x for x in got if x[2] == n} == {x for x in want if x[2] == n}, n


def test_timeline_without_key_is_one_stream(spark):
    ins = inputs()
    outs = {n: make(ins) for group in (CORE, AGGREGATES) for n, make in group.items() if n in ("default_from", "slift2", "last", "sum", "maximum", "reset_count", "sample", "runtime")}
    outs |= {n: DELAYS[n](ins) for n in ("delay_own_const", "period")}
    rows = traces(11, keys=1, ticks=30)
    line = timeline(spark, rows, keys=())
    assert line.split
    got = {(0, *r) for r in events(outs, line.with_df(line.df.drop("k"))).collect()}
    assert got == expected(outs, ins, rows)


def test_null_keys_are_a_timeline(spark):
    ins = inputs()
    outs = {"n": L.count(ins["x"]), "l": L.last(ins["x"], ins["y"])}
    rows = [{**r, "k": None} for r in traces(12, keys=1)]
    want = {r[1:] for r in expected(outs, ins, rows)}
    for split in (False, True):
        assert {tuple(r)[1:] for r in events(outs, timeline(spark, rows, split=split)).collect()} == want


def test_an_empty_timeline_with_keys_is_empty(spark):
    ins = inputs()
    assert events({"n": L.count(ins["x"]), "p": L.period(5)}, timeline(spark, [])).count() == 0


def test_cycles_without_last_or_delay_are_rejected(spark):
    ins = inputs()
    loop = L.recursive(INT, lambda me: L.merge(me, ins["x"]))
    with pytest.raises(RecursionError):
        events({"loop": loop}, timeline(spark, traces(1)))


def test_delay_of_nothing_is_an_error(spark):
    ins = inputs()
    rows = [{"k": 0, "ts": 3, "x": 0}, {"k": 0, "ts": 9, "x": None}]
    with pytest.raises(Exception, match="must be positive"):
        events({"d": L.delay(ins["x"], ins["x"])}, timeline(spark, [{**dict.fromkeys(("y", "b", "c", "u", "s")), **r} for r in rows])).collect()
