"""The scalar functions: arithmetic, comparison, logic, options, lists, sets, maps, strings.

Integers are 64-bit on Spark and an overflow raises; shifts by 64 or more, division, infinities, NaN and
missing keys follow integers without bounds and IEEE doubles, not Spark's defaults.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.expr import FUNCTIONS, NO_VALUE, Expr, Fault, Function, Lambda, apply
from tideline.functions.types import ANY, BOOL, FLOAT, INT, STRING, FrozenMap, Some, Type, list_of, map_of, option, order_key, set_of, show, unify

ZERO = "Division by zero"


def _add(name: str, type: Callable | Type, column: Callable, python: Callable, fault: Callable | None = None) -> None:
    FUNCTIONS[name] = Function(type if callable(type) else lambda *_: type, column, python, fault)


def _message(condition: Column, text: Any) -> Column:
    return F.when(condition, text if isinstance(text, Column) else F.lit(text))


# integers

def _div(a: int, b: int) -> int | Fault:
    return Fault(ZERO) if b == 0 else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def _mod(a: int, b: int) -> int | Fault:
    return Fault(ZERO) if b == 0 else a - b * _div(a, b)


def _safe(b: Column) -> Column:
    return F.when(b == 0, F.lit(1)).otherwise(b)


def _left(a: Column, n: Column) -> Column:
    """a * 2**n, or an overflow error from ANSI arithmetic; negative counts shift right."""
    doubled = a * F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(62)).cast("int"))
    return F.when(a == 0, F.lit(0).cast("long")).when(n < 0, _right(a, -n)).when(n <= 62, doubled).otherwise(doubled * 2)


def _right(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, F.least(F.greatest(n, F.lit(0)), F.lit(63)).cast("int"))


_add("add", INT, lambda a, b: a + b, lambda a, b: a + b)
_add("sub", INT, lambda a, b: a - b, lambda a, b: a - b)
_add("mul", INT, lambda a, b: a * b, lambda a, b: a * b)
_add("div", INT, lambda a, b: F.call_function("div", a, _safe(b)), _div, lambda a, b: _message(b == 0, ZERO))
_add("mod", INT, lambda a, b: a % _safe(b), _mod, lambda a, b: _message(b == 0, ZERO))
_add("negate", INT, lambda a: -a, lambda a: -a)
_add("bitand", INT, lambda a, b: a.bitwiseAND(b), lambda a, b: a & b)
_add("bitor", INT, lambda a, b: a.bitwiseOR(b), lambda a, b: a | b)
_add("bitxor", INT, lambda a, b: a.bitwiseXOR(b), lambda a, b: a ^ b)
_add("bitflip", INT, lambda a: F.bitwise_not(a), lambda a: ~a)
_add("leftshift", INT, _left, lambda a, n: a << n if n >= 0 else a >> -n)
_add("rightshift", INT, lambda a, n: F.when(n < 0, _left(a, -n)).otherwise(_right(a, n)), lambda a, n: a >> n if n >= 0 else a << -n)
_add("max", INT, lambda a, b: F.greatest(a, b), max)
_add("min", INT, lambda a, b: F.least(a, b), min)

# floats

_INF = float("inf")


def _fdiv(a: float, b: float) -> float:
    if b == 0:
        return float("nan") if a == 0 or a != a else math.copysign(_INF, a) * math.copysign(1.0, b)
    return a / b


def _fdiv_column(a: Column, b: Column) -> Column:
    negative = b.cast("string").startswith("-")
    signed = F.when((a > 0) == ~negative, F.lit(_INF)).otherwise(F.lit(-_INF))
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(signed)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _log(x: float, base: float) -> float:
    ln = lambda v: float("nan") if v != v or v < 0 else -_INF if v == 0 else math.log(v)
    return _fdiv(ln(x), ln(base))


def _ln(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(float("nan"))).when(x == 0, F.lit(-_INF)).otherwise(F.ln(x))


def _pow(a: float, b: float) -> float:
    try:
        out = math.pow(a, b)
    except OverflowError:
        out = -_INF if a < 0 and b % 2 else _INF
    except ValueError:
        out = _INF if a == 0 else float("nan")
    return out


def _to_int(x: float) -> int | Fault:
    return Fault(f"Cannot convert {show(x)} to Int") if x != x or abs(x) == _INF else int(x)


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == _INF))


def _guarded(compare: Callable) -> Callable:
    """NaN is above everything to Spark, and comparable to nothing in IEEE arithmetic."""
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & compare(a, b)


_add("fadd", FLOAT, lambda a, b: a + b, lambda a, b: a + b)
_add("fsub", FLOAT, lambda a, b: a - b, lambda a, b: a - b)
_add("fmul", FLOAT, lambda a, b: a * b, lambda a, b: a * b)
_add("fdiv", FLOAT, _fdiv_column, _fdiv)
_add("fnegate", FLOAT, lambda a: -a, lambda a: -a)
_add("pow", FLOAT, lambda a, b: F.pow(a, b), _pow)
_add("log", FLOAT, lambda x, b: _fdiv_column(_ln(x), _ln(b)), _log)
for _name in ("sin", "cos", "tan", "atan"):
    _add(_name, FLOAT, getattr(F, _name), lambda x, f=getattr(math, _name): float("nan") if abs(x) == _INF and f is not math.atan else f(x))
_add("intToFloat", FLOAT, lambda x: x.cast("double"), float)
_add("floatToInt", INT, lambda x: F.when(_finite(x), x).otherwise(F.lit(0.0)).cast("long"), _to_int, lambda x: _message(~_finite(x), F.concat(F.lit("Cannot convert "), x.cast("string"), F.lit(" to Int"))))

# comparison and logic

def _same(a: Column, b: Column) -> Column:
    return a == b


def _eq_type(a: Expr, b: Expr) -> Type:
    unify(a.type, b.type)
    return BOOL


def _equal(a: Expr, b: Expr):
    """Maps have no order to Spark, so their sorted entries are compared; NaN equals nothing."""
    kind = unify(a.type, b.type).name
    if kind == "Map":
        return lambda x, y: F.array_sort(F.map_entries(x)) == F.array_sort(F.map_entries(y))
    return _guarded(_same) if kind == "Float" else _same


_add("eq", _eq_type, _same, lambda a, b: a == b)
_add("neq", _eq_type, lambda a, b: a != b, lambda a, b: a != b)
for _name, _python in (("lt", lambda a, b: a < b), ("leq", lambda a, b: a <= b), ("gt", lambda a, b: a > b), ("geq", lambda a, b: a >= b)):
    _add(_name, BOOL, _python, _python)
    _add(f"f{_name}", BOOL, _guarded(_python), _python)
_add("and", BOOL, lambda a, b: a & b, lambda a, b: a and b)
_add("or", BOOL, lambda a, b: a | b, lambda a, b: a or b)
_add("not", BOOL, lambda a: ~a, lambda a: not a)
_add("ite", lambda c, a, b: unify(a.type, b.type), lambda c, a, b: F.when(c, a).otherwise(b), lambda c, a, b: a if c else b)


def _equality(e, env):
    from tideline.functions.expr import column

    (a, ae), (b, be) = (column(x, env) for x in e.args)
    value = _equal(*e.args)(a, b)
    errors = [x for x in (ae, be) if x is not None]
    return value if e.name == "eq" else ~value, F.coalesce(*errors) if errors else None


def _install() -> None:
    from tideline.functions.expr import SPECIAL

    SPECIAL["eq"] = SPECIAL["neq"] = _equality


_install()

# options

def _inner(x: Expr) -> Type:
    return x.type.args[0] if x.type.args else ANY


_add("Some", lambda x: option(x.type), lambda x, type: F.struct(F.lit(True).alias("some"), x.alias("v")), Some)
_add("isSome", BOOL, lambda x: x["some"], lambda x: x is not None)
_add("isNone", BOOL, lambda x: ~x["some"], lambda x: x is None)
_add("getSome", _inner, lambda x: x["v"], lambda x: Fault(NO_VALUE) if x is None else x.value, lambda x: _message(~x["some"], NO_VALUE))
_add("getSomeOrElse", lambda x, y: unify(_inner(x), y.type), lambda x, y: F.when(x["some"], x["v"]).otherwise(y), lambda x, y: y if x is None else x.value)
_add("Option.toSet", lambda x: set_of(_inner(x)), lambda x: F.when(x["some"], F.array(x["v"])).otherwise(F.array()), lambda x: frozenset() if x is None else frozenset([x.value]))


def option_map(x: Any, f: Callable) -> Any:
    return apply("ite", apply("isSome", x), apply("Some", f(apply("getSome", x))), None)


def option_flat_map(x: Any, f: Callable) -> Any:
    return apply("ite", apply("isSome", x), f(apply("getSome", x)), None)


def option_map2(x: Any, y: Any, f: Callable) -> Any:
    return option_flat_map(x, lambda a: option_map(y, lambda b: f(a, b)))


# objects

def _field_type(x: Expr, name: Expr) -> Type:
    fields = dict(x.type.args)
    if name.value not in fields:
        raise TypeError(f"{x.type} has no member {name.value}")
    return fields[name.value]


_add("field", _field_type, lambda x, name: x[name], lambda x, name: x[name])

# lists

def _elements(xs: Expr, x: Expr) -> Type:
    return list_of(unify(_inner(xs), x.type))


def _range(i: int, n: int) -> Fault:
    return Fault(f"Index {i} out of range for a list of size {n}")


def _index_fault(xs: Column, i: Column) -> Column:
    return _message((i < 0) | (i >= F.size(xs)), F.concat(F.lit("Index "), i.cast("string"), F.lit(" out of range for a list of size "), F.size(xs).cast("string")))


def _fold(args: tuple) -> Type:
    return args[1].type


_add("List.size", INT, lambda xs: F.size(xs).cast("long"), len)
_add("List.isEmpty", BOOL, lambda xs: F.size(xs) == 0, lambda xs: not xs)
_add("List.append", _elements, lambda xs, x, type: F.array_append(xs.cast(type.spark), x), lambda xs, x: (*xs, x))
_add("List.prepend", lambda x, xs: _elements(xs, x), lambda x, xs, type: F.array_prepend(xs.cast(type.spark), x), lambda x, xs: (x, *xs))
_add("List.tail", lambda xs: xs.type, lambda xs: F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda xs: xs[1:])
_add("List.init", lambda xs: xs.type, lambda xs: F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda xs: xs[:-1])
_add("List.get", lambda xs, i: _inner(xs), lambda xs, i: F.get(xs, i.cast("int")), lambda xs, i: xs[i] if 0 <= i < len(xs) else _range(i, len(xs)), _index_fault)
_add("List.set", lambda xs, i, x: _elements(xs, x), lambda xs, i, x, type: F.transform(xs, lambda y, j: F.when(j == i, x).otherwise(y)), lambda xs, i, x: (*xs[:i], x, *xs[i + 1 :]) if 0 <= i < len(xs) else _range(i, len(xs)), lambda xs, i, x: _index_fault(xs, i))
_add("List.head", _inner, lambda xs: F.get(xs, F.lit(0)), lambda xs: xs[0] if xs else _range(0, 0), lambda xs: _index_fault(xs, F.lit(0)))
_add("List.last", _inner, lambda xs: F.get(xs, F.size(xs) - 1), lambda xs: xs[-1] if xs else _range(-1, 0), lambda xs: _index_fault(xs, F.size(xs) - 1))
_add("List.fold", lambda *a: _fold(a), lambda xs, start, f, type: F.aggregate(xs, start.cast(type.spark), lambda acc, x: f(acc, x).cast(type.spark)), lambda xs, start, f: reduce(f, xs, start))

# sets

_canonical = lambda xs: F.array_sort(xs)
_both = lambda a, b: unify(a.type, b.type)
_add("Set.singleton", lambda x: set_of(x.type), lambda x, type: F.array(x), lambda x: frozenset([x]))
_add("Set.add", lambda s, x: set_of(unify(_inner(s), x.type)), lambda s, x, type: _canonical(F.array_union(s.cast(type.spark), F.array(x))), lambda s, x: s | {x})
_add("Set.contains", BOOL, lambda s, x: F.array_contains(s, x), lambda s, x: x in s)
_add("Set.remove", lambda s, x: s.type, lambda s, x: F.array_remove(s, x), lambda s, x: s - {x})
_add("Set.size", INT, lambda s: F.size(s).cast("long"), len)
_add("Set.union", _both, lambda a, b: _canonical(F.array_union(a, b)), lambda a, b: a | b)
_add("Set.intersection", _both, lambda a, b: _canonical(F.array_intersect(a, b)), lambda a, b: a & b)
_add("Set.minus", _both, lambda a, b: F.array_except(a, b), lambda a, b: a - b)
_add("Set.fold", lambda *a: _fold(a), lambda s, start, f, type: F.aggregate(s, start.cast(type.spark), lambda acc, x: f(acc, x).cast(type.spark)), lambda s, start, f: reduce(f, sorted(s, key=order_key), start))

# maps

def _missing(k: Any) -> Fault:
    return Fault(f"Key {show(k)} was not found")


def _entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


_add("Map.add", lambda m, k, v: map_of(unify(_key(m), k.type), unify(_value(m), v.type)),
     lambda m, k, v, type: F.map_concat(F.map_filter(m.cast(type.spark), lambda x, _: x != k), F.create_map(k, v)), lambda m, k, v: FrozenMap({**m, k: v}))
_key = lambda m: m.type.args[0] if m.type.args else ANY
_value = lambda m: m.type.args[1] if m.type.args else ANY
_add("Map.contains", BOOL, lambda m, k: F.map_contains_key(m, k), lambda m, k: k in m)
_add("Map.get", lambda m, k: _value(m), lambda m, k: F.try_element_at(m, k), lambda m, k: m[k] if k in m else _missing(k), lambda m, k: _message(~F.map_contains_key(m, k), F.concat(F.lit("Key "), k.cast("string"), F.lit(" was not found"))))
_add("Map.getOrElse", lambda m, k, d: unify(_value(m), d.type), lambda m, k, d: F.when(F.map_contains_key(m, k), F.try_element_at(m, k)).otherwise(d), lambda m, k, d: m.get(k, d))
_add("Map.inc", lambda m, k: map_of(unify(_key(m), k.type), INT), lambda m, k: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, F.coalesce(F.try_element_at(m, k), F.lit(0).cast("long")) + 1)), lambda m, k: FrozenMap({**m, k: m.get(k, 0) + 1}))
_add("Map.remove", lambda m, k: m.type, lambda m, k: F.map_filter(m, lambda x, _: x != k), lambda m, k: FrozenMap((x, v) for x, v in m.items() if x != k))
_add("Map.size", INT, lambda m: F.size(m).cast("long"), len)
_add("Map.keys", lambda m: list_of(_key(m)), lambda m: F.array_sort(F.map_keys(m)), lambda m: tuple(sorted(m, key=order_key)))
_add("Map.fold", lambda *a: _fold(a), lambda m, start, f, type: F.aggregate(_entries(m), start.cast(type.spark), lambda acc, e: f(acc, e["key"], e["value"]).cast(type.spark)), lambda m, start, f: reduce(lambda acc, kv: f(acc, *kv), sorted(m.items(), key=lambda kv: order_key(kv[0])), start))

# strings

def java_format(pattern: str, value: Any) -> str:
    """%-formatting with the conversions d, o, x, e, f, g, s and a (upper case too)."""
    if "," in pattern.partition("%")[2]:
        head, _, rest = pattern.partition("%")
        return head + format(value, "," if isinstance(value, int) else ",.6f") + rest.lstrip("-+ 0,(#123456789.").lstrip("df")
    if pattern.rstrip().endswith("a") and isinstance(value, float):
        return pattern.partition("%")[0] + value.hex()
    return pattern % (show(value) if "s" in pattern.partition("%")[2] else value)


_add("String.concat", STRING, lambda a, b: F.concat(a, b), lambda a, b: a + b)
_add("String.format", STRING, lambda pattern, x: F.format_string(pattern, x), java_format)
_add("String.formatInt", STRING, lambda pattern, x: F.format_string(pattern, x), java_format)
_add("String.formatFloat", STRING, lambda pattern, x: F.format_string(pattern, x), java_format)


def _show_column(x: Column, t: Type, nested: bool) -> Column:
    n = t.name
    if n == "String":
        return x if not nested else F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    if n in ("Int", "Float", "Bool"):
        return x.cast("string")
    if n == "Unit":
        return F.lit("()")
    if n == "Option":
        return F.when(x["some"], F.concat(F.lit("Some("), _show_column(x["v"], t.args[0], True), F.lit(")"))).otherwise(F.lit("None"))
    if n in ("List", "Set"):
        return F.concat(F.lit(f"{n}("), F.array_join(F.transform(x, lambda y: _show_column(y, t.args[0], True)), ", "), F.lit(")"))
    if n == "Map":
        pair = lambda e: F.concat(_show_column(e["key"], t.args[0], True), F.lit(" -> "), _show_column(e["value"], t.args[1], True))
        return F.concat(F.lit("Map("), F.array_join(F.transform(_entries(x), pair), ", "), F.lit(")"))
    names = [f for f, _ in t.args]
    tuple_ = names == [f"_{i + 1}" for i in range(len(names))]
    parts = []
    for i, (f, s) in enumerate(t.args):
        parts += [F.lit(", ")] if i else []
        parts += [] if tuple_ else [F.lit(f"{f} = ")]
        parts.append(_show_column(x[f], s, True))
    left, right = ("(", ",)" if len(names) == 1 else ")") if tuple_ else ("{", "}")
    return F.concat(F.lit(left), *parts, F.lit(right))


def _to_string(e, env):
    from tideline.functions.expr import column

    value, error = column(e.args[0], env)
    return _show_column(value, e.args[0].type, False), error


_add("toString", STRING, lambda x: x.cast("string"), show)
FUNCTIONS_SHOW = _show_column


def _install_strings() -> None:
    from tideline.functions.expr import SPECIAL

    SPECIAL["toString"] = _to_string


_install_strings()

# records of nested data, by dotted paths

def _lookup(record: str, path: str, kinds: tuple) -> Any:
    try:
        x = json.loads(record)
        for part in path.split("."):
            x = x[part]
    except (ValueError, KeyError, TypeError):
        return Fault(f"no member {path}")
    return x if isinstance(x, kinds) and not isinstance(x, bool) else Fault(f"no member {path}")


_path = lambda record, path: F.get_json_object(record, F.concat(F.lit("$."), path)) if isinstance(path, Column) else F.get_json_object(record, f"$.{path}")
_add("CTF.getInt", INT, lambda r, p: F.expr("null").cast("long") if r is None else F.call_function("try_to_number", F.call_function("get_json_object", r, F.concat(F.lit("$."), p)), F.lit("S999999999999999999")).cast("long"), lambda r, p: _lookup(r, p, (int,)),
     lambda r, p: _message(~F.coalesce(F.call_function("get_json_object", r, F.concat(F.lit("$."), p)).rlike(r"^-?\d{1,18}$"), F.lit(False)), F.concat(F.lit("no member "), p)))
_add("CTF.getString", STRING, lambda r, p: F.call_function("get_json_object", r, F.concat(F.lit("$."), p)), lambda r, p: _lookup(r, p, (str,)),
     lambda r, p: _message(F.call_function("get_json_object", r, F.concat(F.lit("$."), p)).isNull(), F.concat(F.lit("no member "), p)))


def ite(condition: Any, then: Any, otherwise: Any) -> Any:
    return apply("ite", condition, then, otherwise)


__all__ = ["Lambda", "ite", "java_format", "option_flat_map", "option_map", "option_map2"]
