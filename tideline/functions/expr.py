"""Expressions over stream values: one tree, compiled to Spark columns or evaluated in Python.

Functions are entries of ``FUNCTIONS``. Errors are values: a column comes with a second column that has
the error's message or null; nothing is raised before an output asks for the value, and a function that
doesn't need an argument (``ite``, ``and``, ``or``) ignores its error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.types import ANY, BOOL, Type, encode, option, type_of


class Fault(Exception):
    """A language error as a value (division by zero, missing key, ...)."""

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fault) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))


class Operators:
    """Operators shared by expressions and streams; integers have Python's signs, floats have methods."""

    def call(self, name: str, *args: Any) -> Any:
        return apply(name, self, *args)

    __add__ = lambda a, b: a.call("add", b)
    __radd__ = lambda a, b: apply("add", b, a)
    __sub__ = lambda a, b: a.call("sub", b)
    __rsub__ = lambda a, b: apply("sub", b, a)
    __mul__ = lambda a, b: a.call("mul", b)
    __rmul__ = lambda a, b: apply("mul", b, a)
    __floordiv__ = lambda a, b: a.call("div", b)
    __truediv__ = lambda a, b: a.call("fdiv", b)
    __mod__ = lambda a, b: a.call("mod", b)
    __and__ = lambda a, b: a.call("and", b)
    __or__ = lambda a, b: a.call("or", b)
    __invert__ = lambda a: a.call("not")
    __neg__ = lambda a: a.call("negate")
    __lshift__ = lambda a, b: a.call("leftshift", b)
    __rshift__ = lambda a, b: a.call("rightshift", b)
    __lt__ = lambda a, b: a.call("lt", b)
    __le__ = lambda a, b: a.call("leq", b)
    __gt__ = lambda a, b: a.call("gt", b)
    __ge__ = lambda a, b: a.call("geq", b)
    __eq__ = lambda a, b: a.call("eq", b)
    __ne__ = lambda a, b: a.call("neq", b)
    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise TypeError("a stream or expression has no truth value in Python; use &, |, ~ and ite")

    def field(self, name: str) -> Any:
        return self.call("field", Lit(name))


class Expr(Operators):
    type: Type


class Lit(Expr):
    def __init__(self, value: Any, type: Type | None = None) -> None:
        self.value, self.type = value, type or type_of(value)


class Arg(Expr):
    """The i-th argument of a lifted function; ``optional`` ones are options that tell whether there is an event."""

    def __init__(self, i: int, type: Type, optional: bool = False) -> None:
        self.i, self.inner, self.optional = i, type, optional
        self.type = option(type) if optional else type


class Var(Expr):
    """A parameter of a function that is an argument."""

    numbers = count()

    def __init__(self, type: Type) -> None:
        self.type, self.name = type, f"v{next(self.numbers)}"


class Lambda(Expr):
    def __init__(self, params: tuple[Var, ...], body: Expr) -> None:
        self.params, self.body, self.type = params, body, body.type


class Call(Expr):
    def __init__(self, name: str, args: tuple[Expr, ...]) -> None:
        self.name, self.args = name, args
        self.type = FUNCTIONS[name].type(*args)


@dataclass(frozen=True)
class Function:
    """``type`` from argument expressions; ``column`` and ``fault`` from columns; ``python`` from values."""

    type: Callable
    column: Callable
    python: Callable
    fault: Callable | None = None


FUNCTIONS: dict[str, Function] = {}


def wrap(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def apply(name: str, *args: Any) -> Any:
    """Call a function on streams (lifted), expressions or plain values (computed at once)."""
    for a in args:
        lifted = getattr(a, "lift_call", None)
        if lifted is not None:
            return lifted(name, args)
    if any(isinstance(a, Expr) for a in args) or name in ("Map.fold", "Set.fold", "List.fold"):
        return Call(name, tuple(wrap(a) for a in args))
    return FUNCTIONS[name].python(*args)


Env = dict


def column(e: Expr, env: Env) -> tuple[Column, Column | None]:
    """The expression's value and its error (None where it can't fail). ``env``: arguments as (present, value, error)."""
    if isinstance(e, Lit):
        return literal(e.value, e.type), None
    if isinstance(e, Arg):
        present, value, error = env[e.i]
        if not e.optional:
            return value, error
        return F.struct(present.alias("some"), value.alias("v")), None
    if isinstance(e, Var):
        return env[e.name], None
    if isinstance(e, Lambda):
        raise TypeError("a function is no stream value")
    own = SPECIAL.get(e.name)
    if own is not None:
        done = own(e, env)
        if done is not None:
            return done
    values, errors = [], []
    for a in e.args:
        if isinstance(a, Lambda):
            values.append(_lambda(a, env))
            continue
        if isinstance(a, Lit) and e.name in ("field", "String.format", "String.formatInt", "String.formatFloat"):
            values.append(a.value)
            continue
        v, err = column(a, env)
        values.append(v)
        if err is not None:
            errors.append(err)
    f = FUNCTIONS[e.name]
    error = None
    if f.fault is not None:
        message = f.fault(*values)
        errors.append(message)
    if errors:
        error = errors[0] if len(errors) == 1 else F.coalesce(*errors)
    if e.name in TYPED:
        return f.column(*values, type=e.type), error
    return f.column(*values), error


def _lambda(f: Lambda, env: Env) -> Callable:
    def run(*columns: Column) -> Column:
        value, error = column(f.body, env | {p.name: c for p, c in zip(f.params, columns, strict=True)})
        if error is not None:
            value = F.when(error.isNotNull(), F.raise_error(error)).otherwise(value)
        return value

    return run


def literal(value: Any, t: Type) -> Column:
    if t.name in ("Int", "Float", "Bool", "String", "Unit"):
        return F.lit(encode(value, t)).cast(t.spark)
    if t.name == "Any":
        return F.lit(None)
    if t.name in ("List", "Set"):
        items = encode(value, t)
        raw = value if t.name == "List" else sorted(value, key=lambda x: items.index(encode(x, t.args[0])))
        return F.array(*(literal(x, t.args[0]) for x in raw)).cast(t.spark) if items else F.array().cast(t.spark)
    if t.name == "Map":
        pairs = [c for k, v in value.items() for c in (literal(k, t.args[0]), literal(v, t.args[1]))]
        return F.create_map(*pairs).cast(t.spark) if pairs else F.map_from_arrays(F.array(), F.array()).cast(t.spark)
    if t.name == "Option":
        inner = F.lit(None) if value is None else literal(value.value, t.args[0])
        return F.struct(F.lit(value is not None).alias("some"), inner.alias("v")).cast(t.spark)
    return F.struct(*(literal(value[n], s).alias(n) for n, s in t.args))


def evaluate(e: Expr, env: Env) -> Any:
    """The expression's value in Python; raises Fault. ``env``: arguments' values (None, Some or Fault inside for optional ones)."""
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Arg):
        x = env[e.i]
        if isinstance(x, Fault):
            raise x
        return x
    if isinstance(e, Var):
        return env[e.name]
    if isinstance(e, Lambda):
        return lambda *xs: evaluate(e.body, env | {p.name: x for p, x in zip(e.params, xs, strict=True)})
    a = e.args
    if e.name == "ite":
        return evaluate(a[1] if evaluate(a[0], env) else a[2], env)
    if e.name == "and":
        return evaluate(a[0], env) and evaluate(a[1], env)
    if e.name == "or":
        return evaluate(a[0], env) or evaluate(a[1], env)
    if e.name == "getSomeOrElse":
        x = evaluate(a[0], env)
        value = evaluate(a[1], env) if x is None else x.value
        if isinstance(value, Fault):
            raise value
        return value
    value = FUNCTIONS[e.name].python(*(evaluate(x, env) for x in a))
    if isinstance(value, Fault):
        raise value
    return value


def _ite(e: Call, env: Env) -> tuple[Column, Column | None]:
    (c, ce), (a, ae), (b, be) = (column(x, env) for x in e.args)
    t = e.type.spark
    value = F.when(c, a.cast(t) if e.args[1].type != e.type else a).otherwise(b.cast(t) if e.args[2].type != e.type else b)
    branch = None
    if ae is not None or be is not None:
        branch = F.when(c, ae if ae is not None else F.lit(None).cast("string")).otherwise(be if be is not None else F.lit(None).cast("string"))
    return value, branch if ce is None else ce if branch is None else F.coalesce(ce, branch)


def _short(e: Call, env: Env) -> tuple[Column, Column | None]:
    """``and`` and ``or`` need their second argument only where the first leaves it open."""
    (a, ae), (b, be) = (column(x, env) for x in e.args)
    value = a & b if e.name == "and" else a | b
    rest = None if be is None else F.when(a if e.name == "and" else ~a, be)
    return value, rest if ae is None else ae if rest is None else F.coalesce(ae, rest)


def _optional(e: Call, env: Env) -> tuple[Column, Column | None] | None:
    """Questions to an optional argument, without making the option."""
    x = e.args[0]
    if not (isinstance(x, Arg) and x.optional):
        return None
    present, value, error = env[x.i]
    if e.name == "isSome":
        return present, None
    if e.name == "isNone":
        return ~present, None
    if e.name == "getSome":
        missing = F.when(~present, F.lit(NO_VALUE))
        return value, missing if error is None else F.coalesce(error, missing)
    other, other_error = column(e.args[1], env)
    absent = None if other_error is None else F.when(~present, other_error)
    err = error if absent is None else absent if error is None else F.coalesce(error, absent)
    return F.when(present, value).otherwise(other), err


NO_VALUE = "Cannot get value of None"
SPECIAL = {"ite": _ite, "and": _short, "or": _short, "isSome": _optional, "isNone": _optional, "getSome": _optional, "getSomeOrElse": _optional}
#: Functions whose column needs the result's type.
TYPED = {"List.append", "List.prepend", "Set.add", "Map.add", "Some", "Set.singleton", "List.set", "List.fold", "Set.fold", "Map.fold"}


def trace(f: Callable, types: list[Type], optional: bool) -> Expr:
    """The expression that a Python function makes of its arguments."""
    return wrap(f(*(Arg(i, t, optional) for i, t in enumerate(types))))


def function(f: Callable, *types: Type) -> Lambda:
    """A Python function as an argument of ``List.fold`` and the like."""
    params = tuple(Var(t) for t in types)
    return Lambda(params, wrap(f(*params)))


def condition_type(*args: Expr) -> Type:
    return BOOL


def unknown(*args: Expr) -> Type:
    return ANY
