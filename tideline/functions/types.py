"""Value types of streams, with their Spark encodings and conversions.

A stream's value is never null: null means "no event". Options are structs, so that they nest; sets are
sorted arrays without repeats; unit values are ``true``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class Type:
    """A value type; ``args`` are its parameters (fields as (name, type) pairs for objects)."""

    name: str
    args: tuple = ()

    def __str__(self) -> str:
        if self.name == "Object":
            return "{" + ", ".join(f"{n}: {t}" for n, t in self.args) + "}"
        return f"{self.name}[{', '.join(map(str, self.args))}]" if self.args else self.name

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.name](*self.args)


def option(t: Type) -> Type:
    return Type("Option", (t,))


def list_of(t: Type) -> Type:
    return Type("List", (t,))


def set_of(t: Type) -> Type:
    return Type("Set", (t,))


def map_of(k: Type, v: Type) -> Type:
    return Type("Map", (k, v))


def obj(**fields: Type) -> Type:
    return Type("Object", tuple(fields.items()))


INT, FLOAT, BOOL, STRING, UNIT = (Type(n) for n in ("Int", "Float", "Bool", "String", "Unit"))
#: The type of an empty collection's elements or of nothing; it unifies with any other.
ANY = Type("Any")

_SPARK = {
    "Int": T.LongType,
    "Float": T.DoubleType,
    "Bool": T.BooleanType,
    "String": T.StringType,
    "Unit": T.BooleanType,
    "Any": T.NullType,
    "Option": lambda t: T.StructType([T.StructField("some", T.BooleanType()), T.StructField("v", t.spark)]),
    "List": lambda t: T.ArrayType(t.spark),
    "Set": lambda t: T.ArrayType(t.spark),
    "Map": lambda k, v: T.MapType(k.spark, v.spark),
    "Object": lambda *fields: T.StructType([T.StructField(n, t.spark) for n, t in fields]),
}


def unify(a: Type, b: Type) -> Type:
    """The type of either; raises if they have none in common."""
    if a == b or b == ANY:
        return a
    if a == ANY:
        return b
    if a.name == b.name and len(a.args) == len(b.args):
        if a.name == "Object":
            if [n for n, _ in a.args] == [n for n, _ in b.args]:
                return Type("Object", tuple((n, unify(s, t)) for (n, s), (_, t) in zip(a.args, b.args, strict=True)))
        else:
            return Type(a.name, tuple(unify(s, t) for s, t in zip(a.args, b.args, strict=True)))
    raise TypeError(f"{a} and {b} do not match")


class Some:
    """An option that has a value; ``None`` is the one that has none."""

    __slots__ = ("value",)

    def __init__(self, value: Any) -> None:
        self.value = value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Some) and self.value == other.value

    def __hash__(self) -> int:
        return hash(("Some", self.value))

    def __repr__(self) -> str:
        return f"Some({self.value!r})"


class FrozenMap(dict):
    """A map that can be in a set or be a key."""

    def __hash__(self) -> int:
        return hash(frozenset(self.items()))


class Record(FrozenMap):
    """An object: fields by name, in order."""


#: The unit value.
NOTHING = Record()


def type_of(value: Any) -> Type:
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT
    if isinstance(value, float):
        return FLOAT
    if isinstance(value, str):
        return STRING
    if value is None:
        return option(ANY)
    if isinstance(value, Some):
        return option(type_of(value.value))
    common = lambda xs: _common([type_of(x) for x in xs])
    if isinstance(value, Record):
        return Type("Object", tuple((n, type_of(v)) for n, v in value.items())) if value else UNIT
    if isinstance(value, dict):
        return map_of(common(value), common(value.values()))
    if isinstance(value, frozenset | set):
        return set_of(common(value))
    if isinstance(value, list | tuple):
        return list_of(common(value))
    raise TypeError(f"no stream value: {value!r}")


def _common(types: list[Type]) -> Type:
    out = ANY
    for t in types:
        out = unify(out, t)
    return out


def decode(value: Any, t: Type) -> Any:
    """A Spark (or pandas) value as the Python value that functions take."""
    n = t.name
    if n == "Int":
        return int(value)
    if n == "Float":
        return float(value)
    if n == "Bool":
        return bool(value)
    if n == "Unit":
        return NOTHING
    if n == "Option":
        return Some(decode(value["v"], t.args[0])) if value["some"] else None
    if n == "List":
        return tuple(decode(x, t.args[0]) for x in value)
    if n == "Set":
        return frozenset(decode(x, t.args[0]) for x in value)
    if n == "Map":
        items = value.items() if isinstance(value, dict) else value
        return FrozenMap((decode(k, t.args[0]), decode(v, t.args[1])) for k, v in items)
    if n == "Object":
        return Record((f, decode(value[f], s)) for f, s in t.args)
    return value


def encode(value: Any, t: Type) -> Any:
    """The reverse of ``decode``."""
    n = t.name
    if n == "Unit":
        return True
    if n == "Option":
        return {"some": isinstance(value, Some), "v": encode(value.value, t.args[0]) if isinstance(value, Some) else None}
    if n == "List":
        return [encode(x, t.args[0]) for x in value]
    if n == "Set":
        return [encode(x, t.args[0]) for x in sorted(value, key=order_key)]
    if n == "Map":
        return [(encode(k, t.args[0]), encode(v, t.args[1])) for k, v in sorted(value.items(), key=lambda kv: order_key(kv[0]))]
    if n == "Object":
        return {f: encode(value[f], s) for f, s in t.args}
    return value


def order_key(x: Any) -> Any:
    return (str(type(x)), x if not isinstance(x, frozenset | dict | Some) and x is not None else repr(x))


def show(value: Any, nested: bool = False) -> str:
    """A value as traces print it; strings have quotes only inside other values."""
    if value is True or value is False:
        return str(value).lower()
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if nested else value
    if isinstance(value, float):
        return show_float(value)
    if value is None:
        return "None"
    inside = lambda xs: ", ".join(show(x, True) for x in xs)
    if isinstance(value, Some):
        return f"Some({show(value.value, True)})"
    if isinstance(value, Record):
        if list(value) == [f"_{i + 1}" for i in range(len(value))]:
            return f"({inside(value.values())}{',' if len(value) == 1 else ''})"
        return "{" + ", ".join(f"{k} = {show(v, True)}" for k, v in value.items()) + "}"
    if isinstance(value, dict):
        return "Map(" + ", ".join(f"{show(k, True)} -> {show(v, True)}" for k, v in sorted(value.items(), key=lambda kv: order_key(kv[0]))) + ")"
    if isinstance(value, frozenset | set):
        return f"Set({inside(sorted(value, key=order_key))})"
    if isinstance(value, list | tuple):
        return f"List({inside(value)})"
    return str(value)


def show_float(x: float) -> str:
    """Plain digits from 0.001 to 10,000,000, else scientific with an upper-case E, as the JVM prints doubles."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        text = repr(x)
        if "e" in text:
            text = f"{x:.17f}".rstrip("0")
        return text + "0" if text.endswith(".") else text
    mantissa, _, exponent = f"{x:.16e}".partition("e")
    for digits in range(1, 17):
        short = f"{x:.{digits}e}"
        if float(short) == x:
            mantissa, _, exponent = short.partition("e")
            break
    return f"{mantissa.rstrip('0') + '0' if mantissa.rstrip('0').endswith('.') else mantissa.rstrip('0')}E{int(exponent)}"
