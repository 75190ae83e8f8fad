"""Scalar functions: columns against Python values, with IEEE and whole-number corner cases."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalars  # noqa: F401
from tideline.functions.expr import FUNCTIONS, Arg, Fault, Lit, apply, column, evaluate, function
from tideline.functions.types import BOOL, FLOAT, INT, STRING, FrozenMap, Some, Type, decode, encode, list_of, map_of, option, set_of, show, unify

INTS = [0, 1, -1, 2, -7, 7, 63, 64, -3, 1 << 40]
FLOATS = [0.0, -0.0, 1.0, -1.5, float("inf"), float("-inf"), float("nan"), 1e300, 2.0, 0.1]


def both(spark, e, rows, kinds):
    """(Spark's, Python's) results of an expression over rows of arguments; errors as ("error", text)."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f"a{i}", k.spark) for i, k in enumerate(kinds)])
    df = spark.createDataFrame([tuple(_row(encode(v, k), k) for v, k in zip(r, kinds, strict=True)) for r in rows], schema).coalesce(1)
    value, error = column(e, {i: (F.lit(True), F.col(f"a{i}"), None) for i in range(len(kinds))})
    error = F.lit(None).cast("string") if error is None else error
    got = df.select(F.when(error.isNull(), value).alias("v"), error.alias("e")).collect()
    out = []
    for row, r in zip(got, rows, strict=True):
        try:
            want = evaluate(e, dict(enumerate(r)))
        except Fault as fault:
            want = ("error", str(fault))
        out.append((("error", row.e) if row.e is not None else decode(row.v.asDict(True) if hasattr(row.v, "asDict") else row.v, e.type), want))
    return out


def _row(x, k):
    return dict(x) if k.name == "Map" else x


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or a != a and b != b or math.isclose(a, b, rel_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", ["add", "sub", "mul", "div", "mod", "bitand", "bitor", "bitxor", "max", "min", "eq", "neq", "lt", "leq", "gt", "geq"])
def test_int_pairs(spark, name):
    e = apply(name, Arg(0, INT), Arg(1, INT))
    rows = [(a, b) for a in INTS for b in INTS if not (name == "mul" and abs(a * b) >= 1 << 63)]
    for got, want in both(spark, e, rows, [INT, INT]):
        assert same(got, want)


def test_shifts(spark):
    rows = [(a, n) for a in (0, 1, -1, 5, -9) for n in (0, 1, 3, 40, -1, -2, -70)]
    for name in ("leftshift", "rightshift"):
        usable = [(a, n) for a, n in rows if abs(FUNCTIONS[name].python(a, n)) < 1 << 62]
        for got, want in both(spark, apply(name, Arg(0, INT), Arg(1, INT)), usable, [INT, INT]):
            assert got == want


@pytest.mark.parametrize("name", ["fadd", "fsub", "fmul", "fdiv", "log", "flt", "fleq", "fgt", "fgeq", "eq", "neq"])
def test_float_pairs(spark, name):
    rows = [(a, b) for a in FLOATS for b in FLOATS]
    for (got, want), r in zip(both(spark, apply(name, Arg(0, FLOAT), Arg(1, FLOAT)), rows, [FLOAT, FLOAT]), rows, strict=True):
        assert same(got, want), (name, r)


def test_float_to_int_and_shown(spark):
    for name, values, k in (("floatToInt", FLOATS[:6] + [2.9, -2.9, float("nan")], FLOAT), ("intToFloat", INTS, INT), ("negate", INTS, INT), ("bitflip", INTS, INT)):
        for got, want in both(spark, apply(name, Arg(0, k)), [(v,) for v in values], [k]):
            assert same(got, want) or isinstance(got, tuple) and got[0] == want[0]
    for got, want in both(spark, apply("toString", Arg(0, FLOAT)), [(v,) for v in (0.5, 1e63, 123456.75, 1e7, 1e-4, float("nan"), float("inf"), -2.0)], [FLOAT]):
        assert got == want


def test_lists(spark):
    kind, rows = list_of(INT), [((1, 2, 3), 0), ((), 1), ((5,), 2), ((4, 4), -1)]
    x, i = Arg(0, kind), Arg(1, INT)
    plus = function(lambda acc, v: acc * 2 + v, INT, INT)
    for e in (apply("List.size", x), apply("List.isEmpty", x), apply("List.append", x, i), apply("List.prepend", i, x), apply("List.tail", x), apply("List.init", x), apply("List.get", x, i), apply("List.set", x, i, 9), apply("List.head", x), apply("List.last", x), apply("List.fold", x, Lit(1), plus), apply("toString", x)):
        for got, want in both(spark, e, rows, [kind, INT]):
            assert got == want or got[0] == want[0] == "error"


def test_sets_and_maps(spark):
    s, v = Arg(0, set_of(INT)), Arg(1, INT)
    rows = [(frozenset({3, 1}), 1), (frozenset(), 2), (frozenset({2, 9, 4}), 4)]
    for e in (apply("Set.add", s, v), apply("Set.remove", s, v), apply("Set.contains", s, v), apply("Set.size", s), apply("Set.union", s, frozenset({8})), apply("Set.intersection", s, frozenset({1, 4})), apply("Set.minus", s, frozenset({1, 4})), apply("Set.singleton", v), apply("Set.fold", s, Lit(0), function(lambda a, x: a + x, INT, INT))):
        for got, want in both(spark, e, rows, [set_of(INT), INT]):
            assert got == want
    kind = map_of(STRING, INT)
    m, k = Arg(0, kind), Arg(1, STRING)
    rows = [(FrozenMap(a=1, b=2), "a"), (FrozenMap(), "q"), (FrozenMap(z=3), "a")]
    for e in (apply("Map.add", m, k, 7), apply("Map.get", m, k), apply("Map.getOrElse", m, k, -1), apply("Map.contains", m, k), apply("Map.remove", m, k), apply("Map.size", m), apply("Map.keys", m), apply("Map.inc", m, k), apply("Map.fold", m, Lit(0), function(lambda a, key, x: a + x, INT, STRING, INT)), m == m, apply("toString", m)):
        for got, want in both(spark, e, rows, [kind, STRING]):
            assert got == want or got[0] == want[0] == "error"


def test_options_nest(spark):
    kind = option(option(INT))
    x = Arg(0, kind)
    rows = [(None,), (Some(None),), (Some(Some(3)),)]
    for e in (apply("isSome", x), apply("isNone", x), apply("getSomeOrElse", apply("getSomeOrElse", x, None), -1), apply("toString", x), apply("Set.size", apply("Option.toSet", apply("getSomeOrElse", x, None)))):
        for got, want in both(spark, e, rows, [kind]):
            assert got == want


def test_records_by_path(spark):
    rows = [('{"a": {"b": 5, "c": "t"}}',), ('{"a": 1}',)]
    for e in (apply("CTF.getInt", Arg(0, STRING), "a.b"), apply("CTF.getString", Arg(0, STRING), "a.c")):
        for got, want in both(spark, e, rows, [STRING]):
            assert got == want


def test_types_unify_and_show():
    assert unify(list_of(Type("Any")), list_of(INT)) == list_of(INT)
    with pytest.raises(TypeError):
        unify(INT, BOOL)
    assert show(("a", "b")) == 'List("a", "b")' and show("a") == "a" and show(Some(1.0)) == "Some(1.0)"
