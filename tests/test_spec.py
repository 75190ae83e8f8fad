"""Specifications as text: what they compute, and what they reject."""

import pytest

from tideline.functions.expr import Fault
from tideline.functions.types import decode, show
from tideline.operators import graph as g
from tideline.operators import library as L
from tideline.operators.stepper import Stepper
from tideline.plans.docs import documented, markdown
from tideline.plans.spec import SpecError, compile_spec
from tideline.sources.trace import events_of_line


def run(text: str, trace: str, **options) -> set[str]:
    """Output lines of a specification over a text trace, by the stepper."""
    spec = compile_spec(text, **options)
    kinds = {n: s.type for n, s in spec.inputs.items()}
    ticks: dict[int, dict] = {}
    for line in trace.splitlines():
        for ts, stream, value in events_of_line(line, kinds):
            tick = ticks.setdefault(ts, {})
            if stream in kinds:
                tick[spec.inputs[stream].id] = decode(value, kinds[stream])
    out = set()
    for ts, values in Stepper(spec.outputs.values()).run(sorted(ticks.items())):
        for n, s in spec.outputs.items():
            v = values.get(g.resolve(s).id, ...)
            if v is not ...:
                out.add(f"{ts}: {n} = {v if isinstance(v, Fault) else show(v)}")
    return out


def lines(text: str) -> set[str]:
    return {x.strip() for x in text.strip().splitlines()}


def test_operators_precedence_and_signals():
    assert run("in a: Events[Int]\nin b: Events[Int]\nout a + b * 2 - 1 as r\nout a << 1 & 6 | 1 as bits\nout !(a > b) && true as c", "1: a = 3\n2: b = 4\n5: a = 10") == lines(
        """1: bits = 7
        2: r = 10
        2: c = true
        5: r = 17
        5: bits = 5
        5: c = false"""
    )


def test_if_needs_a_value_in_both_branches():
    assert run("in c: Events[Bool]\nin x: Events[Int]\nin y: Events[Int]\nout if c then x else y as r", "1: c = true\n2: x = 5\n3: y = 6\n4: c = false") == {"3: r = 5", "4: r = 6"}


def test_recursive_definition_and_generic_macro():
    text = """
    def counted[T](s: Events[T]): Events[Int] = n where {
      def n: Events[Int] = default(last(n, s) + 1, 0)
    }
    in x: Events[String]
    out counted(x) as n
    """
    assert run(text, '2: x = "a"\n5: x = "b"') == {"0: n = 0", "2: n = 1", "5: n = 2"}


def test_compile_time_recursion_by_static_if():
    text = "def nth[T](s: Events[T], n: Int): Events[T] = static if n == 0 then s else last(nth(s, n - 1), s)\nin x: Events[Int]\nout nth(x, 2) as r"
    assert run(text, "1: x = 1\n2: x = 2\n3: x = 3\n4: x = 4") == {"3: r = 1", "4: r = 2"}


def test_liftable_functions_lambdas_and_named_arguments():
    text = """
    @liftable def mix(a: Int, b: Int) = a * 10 + b
    in x: Events[Int]
    in y: Events[Int]
    out mix(b = x, a = y) as m
    out mix(1, 2) as constant
    out lift(x, y, (a: Option[Int], b: Option[Int]) => if isSome(a) && isSome(b) then Some(getSome(a) + getSome(b)) else None[Int]) as both
    out fold(x, 100, (acc: Int, v: Int) => acc - v) as f
    out reduce(x, max) as top
    """
    assert run(text, "1: x = 3\n2: y = 4\n2: x = 1\n3: x = 7") == lines(
        """0: constant = 12
        0: f = 100
        1: f = 97
        1: top = 3
        2: m = 41
        2: both = 5
        2: f = 96
        2: top = 3
        3: m = 47
        3: f = 89
        3: top = 7"""
    )


def test_objects_tuples_modules_types_and_text():
    text = """
    type Pair[T] = {left: T, right: T}
    module Geo {
      def scale = 3
      def grow(n: Int) = n * scale
    }
    in x: Events[Int]
    in p: Events[(Int, String)]
    def both = {left = x, right = Geo.grow(x)}
    out both.right - both.left as diff
    out p._2 as name
    out "x=$x, p=${p._1 + 1}\\n" as t
    out f"$x%03d" as f
    out (x, 1.5) as tup
    out List.append(List.append(List.empty[Int], x), 2) as l
    """
    assert run(text, '1: x = 2\n2: p = (5, "q")') == {'1: diff = 4', "1: f = 002", "1: tup = (2, 1.5)", "1: l = List(2, 2)", "2: name = q", "2: t = x=2, p=6\n"}


def test_durations_scale_to_the_time_unit():
    assert run("in x: Events[Int]\nout x + 2ms as r", "1: x = 1", time_unit="us") == {"1: r = 2001"}
    with pytest.raises(SpecError, match="whole number"):
        compile_spec("in x: Events[Int]\nout x + 2us", "ms")


def test_errors_are_values_until_an_output_needs_them():
    text = "in x: Events[Int]\nout if x == 0 then 0 else 10 / x as safe\nout 10 / x as bare\nout const(1, 10 / x) as c\nout x != 0 && 10 / x > 2 as guarded"
    assert run(text, "1: x = 0\n2: x = 2") == {"1: safe = 0", "1: bare = Division by zero", "1: c = 1", "1: guarded = false", "2: safe = 5", "2: bare = 5", "2: c = 1", "2: guarded = true"}


def test_out_all_and_default_names():
    text = "in x: Events[Int]\ndef y = x + 1\nout *"
    assert run(text, "1: x = 1") == {"1: x = 1", "1: y = 2"}
    assert set(compile_spec("in x: Events[Int]\nout x  +  1").outputs) == {"x + 1"}


def test_library_by_its_names():
    text = """
    in e: Events[Unit]
    in r: Events[Unit]
    in v: Events[Int]
    out resetCount(e, reset = r) as c
    out bursts(e, burstLength = 4, waitingPeriod = 2, burstAmount = 2) as b
    out sample(v, 3) as s
    out merge3(v, time(e), 7) as m
    out Map.collectCount(v) as mc
    out Set.collect(v) as st
    out average(v) as av
    """
    got = run(text, "1: e\n2: e\n2: v = 4\n3: e\n3: v = 6\n5: r\n6: v = 4")
    assert {"3: c = 3", "5: c = 0", "3: b = false", "2: s = 4", "6: s = 4", "0: m = 7", "1: m = 1", "2: m = 4", "6: mc = Map(4 -> 2, 6 -> 1)", "6: st = Set(4, 6)", "6: av = 4"} <= got
    assert "3: s = 6" not in got


def test_blocks_raw_outputs_tuples_aliases_and_functions_of_functions():
    text = """
    in x: Events[Int]
    def turned(a: Events[Int]) = {
      def b = -a
      return b * 2
    }
    type P[T] = (T, T)
    def swap[A](p: P[A]): P[A] = (p._2, p._1)
    @liftable def apart(p: (Int, Int)): Int = p._1 - p._2
    @raw out turned(x) as t
    print x
    out merge(x, 0) as m
    out x > 3 &&
      x < 10 as range
    out if x > 2
      then "big"
      else "small" as size
    out (x,) as one
    out swap((x, 5)) as sw
    out apart((x, 3)) as d
    out slift(x, 4, (a: Int, b: Int) => a * b) as sl
    out Map.get(Map.add(Map.empty[Int, String], x, "v"), x) as mg
    out List.fold(List.append(List.empty[Int], x), 1, (a: Int, b: Int) => a + b) as lf
    out f"${x}%d and ${intToFloat(x)}%.2f" as ft
    out nil[Int] as none
    """
    assert run(text, "2: x = 1\n4: x = 7") == lines(
        """0: m = 0
        2: t = -2
        2: x = 1
        2: m = 1
        2: range = false
        2: size = small
        2: one = (1,)
        2: sw = (5, 1)
        2: d = -2
        2: sl = 4
        2: mg = v
        2: lf = 2
        2: ft = 1 and 1.00
        4: t = -14
        4: x = 7
        4: m = 7
        4: range = true
        4: size = big
        4: one = (7,)
        4: sw = (5, 7)
        4: d = 4
        4: sl = 28
        4: mg = v
        4: lf = 8
        4: ft = 7 and 7.00"""
    )
    assert compile_spec(text).raw == {"t", "x"}


def test_periodic_recursive_delay():
    text = "in e: Events[Unit]\ndef p: Events[Int] = const(3, default(delay(p, ()), ()))\nout p"
    assert run(text, "1: e\n10: e") == {"0: p = 3", "3: p = 3", "6: p = 3", "9: p = 3"}


def test_operators_of_the_callers_own():
    text = "in x: Events[Int]\nin y: Events[Int]\nout spread(x, y + 1) as s\nout spread(x, 3) as t"
    own = {"spread": lambda a, b: L.maximum(L.merge(a, b)) - L.minimum(L.merge(a, b))}
    assert run(text, "1: x = 5\n2: y = 1\n3: x = 9", builtins=own) == {"0: t = 0", "1: s = 0", "1: t = 2", "2: s = 3", "3: s = 7", "3: t = 6"}
    with pytest.raises(SpecError, match="not defined"):
        compile_spec(text)


def test_documentation_of_definitions():
    text = """
## The level, in
## millimetres
in level: Events[Int]
# no documentation
--- Twice a value
@liftable
def twice[T](a: T, f: (T, T) => T): T = f(a, a)
module Limits { # of the tank
  ## Where it spills
  def high = 10
  type Range = {low: Int, high: Int}
}
def state: Events[Int] = level
out level > Limits.high as over
"""
    docs = documented(text)
    assert [(d.kind, d.name, d.text) for d in docs] == [
        ("in", "level", "The level, in\nmillimetres"), ("def", "twice", "Twice a value"), ("module", "Limits", ""),
        ("def", "Limits.high", "Where it spills"), ("type", "Limits.Range", ""), ("def", "state", ""),
    ]
    assert [d.signature for d in docs] == ["in level: Events[Int]", "def twice[T](a: T, f: (T, T) => T): T", "module Limits", "def high", "type Range", "def state: Events[Int]"]
    shown = markdown(docs)
    assert shown.startswith("# Definitions\n") and "## Limits.high\n\n```\ndef high\n```\n\nWhere it spills\n" in shown


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("out y", "not defined"),
        ("in x: Events[Int]\nout x + true", "takes Int"),
        ("in x: Events[Int]\nout x +. 1.0", "takes Float"),
        ("in x: Events[Int]\ndef y = merge(y, x)\nout y", "must declare"),
        ("in x: Events[Int]\ndef y: Events[Int] = merge(y, x)\nout y", "at the same time"),
        ("def a = 1\ndef a = 2", "twice"),
        ("def f(a: Int) = a\nin x: Events[Int]\nout f(x, x)", "arguments"),
        ("in x: Int", "must be a stream"),
        ("in x: Events[Int]\nout x.y", "no member"),
        ("in x: Events[Int]\nout (x", "expected"),
        ("in x: Events[Int]\nout static if x > 1 then x else x", "constant"),
        ('in x: Events[Int]\nout "$', "name must follow"),
        ("import a.b", "not supported"),
        ("in x: Events[Int]\nout x == true", "do not match"),
    ],
)
def test_rejected_specifications(text, message):
    with pytest.raises((SpecError, RecursionError), match=message):
        compile_spec(text)
