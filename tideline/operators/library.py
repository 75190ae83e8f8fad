"""The library of stream operators, built from the core nodes.

Operators that count or collect over ``default(... last(self) ...)`` lose events at time 0, because
``last`` has nothing there; folds don't. That difference is part of their meaning.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tideline.functions.expr import Expr, Lit, apply, trace
from tideline.functions.scalars import ite
from tideline.functions.types import BOOL, INT, NOTHING, option, set_of
from tideline.operators.graph import Collected, Const, Default, DefaultFrom, Delay, Fold, Last, Lift, Merge, Nil, On, Period, SignalLift, Stream, Time, recursive

MAX_ARITY = 5


def some(x: Any) -> Expr:
    return apply("Some", x) if isinstance(x, Expr) else Lit(None) if x is None else apply("Some", Lit(x))


def nothing(t: Any) -> Expr:
    return Lit(None, option(t))


# core

def nil() -> Stream:
    return Nil()


def default(stream: Stream, value: Any) -> Stream:
    return Default(stream, value)


def default_from(values: Stream, defaults: Stream) -> Stream:
    return DefaultFrom(values, defaults)


def last(stream: Stream, trigger: Stream) -> Stream:
    return Last(stream, trigger)


def time(stream: Stream) -> Stream:
    return Time(stream)


def delay(delays: Stream, resets: Stream) -> Stream:
    return Delay(delays, resets)


def lift(f: Callable, *streams: Stream) -> Stream:
    """``f`` takes an option of each stream and gives an option."""
    return Lift(f, streams)


def signal_lift(f: Callable, *streams: Stream) -> Stream:
    return SignalLift(f, streams)


lift1 = lift2 = lift3 = lift4 = lift5 = lift
slift = slift1 = slift2 = slift3 = slift4 = slift5 = signal_lift


def curried(f: Callable) -> Callable:
    """A value function as a function of streams, to be an argument of another operator."""
    return lambda *streams: SignalLift(f, streams)


slift1_curried = slift2_curried = slift3_curried = slift4_curried = slift5_curried = curried


# filters, projections, merges

def const(value: Any, stream: Stream) -> Stream:
    return Const(value, stream)


def first(a: Stream, b: Stream) -> Stream:
    """The current value of ``a`` whenever either has an event and both have a value."""
    return SignalLift(lambda x, _: x, [a, b])


def prev(a: Stream) -> Stream:
    return Last(a, a)


def merge(*streams: Stream) -> Stream:
    return Merge(streams)


merge3 = merge4 = merge5 = merge6 = merge7 = merge8 = merge


def merge_unit(*streams: Stream) -> Stream:
    return Merge([Const(NOTHING, s) for s in streams])


merge_unit3 = merge_unit4 = merge_unit


def filter(events: Stream, condition: Stream) -> Stream:
    """The events at which the condition, as of then, holds."""
    return Lift(lambda e, c: ite(apply("isSome", e) & apply("getSomeOrElse", c, False), e, nothing(events.type)), [events, On(events, condition)])


def pure(x: Stream) -> Stream:
    """The events that differ from their predecessor."""
    return Lift(lambda now, before: ite(apply("isNone", before) | (apply("getSome", before) != apply("getSome", now)), now, nothing(x.type)), [x, Last(x, x)])


def is_first(x: Stream) -> Stream:
    return Default(Lift(lambda now, before: apply("Some", apply("isNone", before)), [x, Last(x, x)]), False)


def first_event(x: Stream) -> Stream:
    return Lift(lambda now, before: ite(apply("isNone", before), now, nothing(x.type)), [x, Last(x, x)])


def had_any_event(x: Stream) -> Stream:
    return Default(Const(True, x), False)


defined = had_any_event


def const_if(value: Any, condition: Stream) -> Stream:
    kept = trace(lambda c: ite(apply("getSome", c), some(value), None), [BOOL], optional=True)
    return Lift(kept, [condition])


def unit_if(condition: Stream) -> Stream:
    return const_if(NOTHING, condition)


def on(trigger: Stream, stream: Stream) -> Stream:
    return On(trigger, stream)


def rising(condition: Stream) -> Stream:
    return unit_if(SignalLift(lambda now, before: now & ~before, [condition, Last(condition, condition)]))


def falling(condition: Stream) -> Stream:
    return unit_if(SignalLift(lambda now, before: ~now & before, [condition, Last(condition, condition)]))


def sample(e: Stream, rate: int) -> Stream:
    """The first event, then each that comes ``rate`` or more after the last one let through."""
    return recursive(e.type, lambda me: Merge([filter(e, (Time(e) - Last(Time(me), e)) >= rate), first_event(e)]))


# running aggregates

def fold(stream: Stream, init: Any, f: Callable) -> Stream:
    return Fold(stream, init, f)


def reduce(stream: Stream, f: Callable) -> Stream:
    return Fold(stream, None, f)


def count(x: Stream) -> Stream:
    return Fold(x, 0, lambda n, _: n + 1)


def sum(x: Stream) -> Stream:
    return Fold(x, 0, lambda a, b: a + b)


def maximum(x: Stream) -> Stream:
    return Fold(x, None, lambda a, b: apply("max", a, b))


def minimum(x: Stream) -> Stream:
    return Fold(x, None, lambda a, b: apply("min", a, b))


def average(x: Stream) -> Stream:
    """The whole-number average of all values so far."""
    counted = Lift(lambda n: ite(apply("getSome", n) != 0, n, nothing(INT)), [count(x)])
    return SignalLift(lambda total, n: total // n, [On(counted, sum(x)), counted])


def reset_count(events: Stream, reset: Stream) -> Stream:
    """Events since the last reset: 1 if both come at once, 0 at a reset alone and at time 0.

    Events at time 0 aren't counted, and a reset before the first event gives nothing.
    Running counts give it without recursion: the count now, less the count before the last reset.
    """
    e, r = _after_zero(events), _after_zero(reset)
    seen = count(e)
    before = Lift(lambda x, n: ite(apply("isSome", x), apply("Some", apply("getSomeOrElse", n, 0)), nothing(INT)), [r, Last(seen, r)])
    either = Merge([Const(NOTHING, e), Const(NOTHING, r)])
    n = Lift(
        lambda at, now, base, any_: ite(apply("isSome", at) & apply("isSome", any_), apply("Some", apply("getSomeOrElse", now, 0) - apply("getSomeOrElse", base, 0)), nothing(INT)),
        [either, On(either, seen), On(either, before), On(either, e)],
    )
    return Default(n, 0)


def _after_zero(x: Stream) -> Stream:
    return Lift(lambda e, t: ite(apply("getSomeOrElse", t, 0) > 0, e, nothing(x.type)), [x, Time(x)])


def no_event(on_: Stream, since: Stream) -> Stream:
    return reset_count(on_, since) == 0


def runtime(call: Stream, ret: Stream) -> Stream:
    """At each return the time since the latest call."""
    return SignalLift(lambda t, s: t - s, [Time(ret), On(ret, Time(call))])


def bursts(e: Stream, length: int, wait: int, amount: int) -> Stream:
    """Whether at most ``amount`` events come within ``length`` of a burst's start and none in the ``wait`` after it."""
    starts = recursive(e.type, lambda me: DefaultFrom(filter(e, (Time(e) - Last(Time(me), e)) >= length + wait), e))
    return _burst_verdict(e, starts, length, amount)


def bursts_since(e: Stream, length: int, wait: int, amount: int, since: Stream) -> Stream:
    """Like ``bursts``; a burst also starts with the first event after each event of ``since``."""

    def starts(me: Stream) -> Stream:
        before = Last(Time(me), e)
        return DefaultFrom(filter(e, (before < On(e, Time(since))) | ((Time(e) - before) >= length + wait)), e)

    return _burst_verdict(e, recursive(e.type, starts), length, amount)


def _burst_verdict(e: Stream, starts: Stream, length: int, amount: int) -> Stream:
    inside = Default(SignalLift(lambda now, start: now < start + length, [Time(e), Time(starts)]), True)
    return (reset_count(e, starts) <= amount) & inside


def period(every: int) -> Stream:
    return Period(every)


# running collections

def collect_count(events: Stream) -> Stream:
    return Collected("count", [events])


def collect_max(key: Stream, value: Stream) -> Stream:
    return Collected("max", [key, value])


def collect_min(key: Stream, value: Stream) -> Stream:
    return Collected("min", [key, value])


def counting(x: Stream) -> Stream:
    """Numbers for the values of ``x``, from 1, in the order in which they first come."""
    return Collected("counting", [x])


def collect_set(value: Stream) -> Stream:
    return Collected("set", [value])


def collect_set_with_remove(value: Stream, remove: Stream) -> Stream:
    """The values that came and weren't removed since; a removal wins a tie."""
    kind = set_of(value.type)

    def body(me: Stream) -> Stream:
        step = lambda s, v, r: apply("Some", apply("Set.minus", apply("Set.union", apply("getSome", s), apply("Option.toSet", v)), apply("Option.toSet", r)))
        return Default(Lift(step, [Last(me, Merge([value, remove])), value, remove]), Lit(frozenset(), kind))

    return recursive(kind, body)


def last_n(stream: Stream, n: int) -> Stream:
    """The n-th event before the present one, at each event that has one."""
    out = stream
    for _ in range(n):
        out = Last(out, stream)
    return out
