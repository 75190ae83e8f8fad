"""Tick-by-tick evaluation of a stream graph in Python, with bounded state.

The state is what the operators remember: last values, folds, timers. It is used for recursions that
have no closed form on Spark (one key after the other, rows in time order, batch by batch), for the
online engine and for Structured Streaming, whose state store keeps ``snapshot``.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from tideline.functions.expr import Fault, evaluate
from tideline.functions.types import NOTHING, Some
from tideline.operators import graph as g


class Stepper:
    """Evaluates ``outputs`` over ticks in order of time; ``given`` nodes get their events from outside, like inputs."""

    def __init__(self, outputs: Iterable[g.Stream], given: Iterable[g.Stream] = ()) -> None:
        self.outputs = [g.resolve(s) for s in outputs]
        self.given = {g.resolve(s).id for s in given}
        nodes: dict[int, g.Stream] = {}
        todo = list(self.outputs)
        while todo:
            s = todo.pop()
            if s.id not in nodes:
                nodes[s.id] = s
                if s.id not in self.given:
                    todo += [g.resolve(d) for d in s.deps]
        self.order = [s for s in g.within_tick([nodes[i] for i in sorted(nodes)]) if s.id not in self.given and not isinstance(s, g.Input)]
        self.steps = [(s, [g.resolve(d).id for d in s.deps]) for s in self.order]
        self.sampled = {d for s, deps in self.steps for d in (deps if isinstance(s, g.SignalLift) else deps[1:] if isinstance(s, g.On) else deps[:1] if isinstance(s, g.Last) or isinstance(s, g.Collected) and len(deps) > 1 else [])}
        self.delays = [(s, deps) for s, deps in self.steps if isinstance(s, g.Delay)]
        self.periods = [s for s in self.order if isinstance(s, g.Period)]
        self.reset()

    def reset(self) -> None:
        self.now = 0
        self.began = False
        self.current: dict[int, Any] = {}  # the last value of each stream that a lift, on or last asks for
        self.memory: dict[int, Any] = {}  # folds; default_from's "something came out"
        self.timers: dict[int, int] = {s.id: 0 for s in self.periods}

    def snapshot(self) -> tuple:
        return self.now, self.began, dict(self.current), dict(self.memory), dict(self.timers)

    def restore(self, state: tuple) -> None:
        self.now, self.began, self.current, self.memory, self.timers = state[0], state[1], dict(state[2]), dict(state[3]), dict(state[4])

    def next_timer(self) -> int | None:
        return min(self.timers.values(), default=None)

    def due(self, until: int) -> Iterable[tuple[int, dict[int, Any]]]:
        """The ticks before ``until`` that nothing but timers makes, and tick 0 if it hasn't been."""
        if not self.began and until > 0:
            yield 0, self.tick(0, {})
        while self.timers:
            at = min(self.timers.values())
            if at >= until:
                return
            yield at, self.tick(at, {})

    def run(self, ticks: Iterable[tuple[int, dict[int, Any]]]) -> Iterable[tuple[int, dict[int, Any]]]:
        """All ticks with their values, of input ticks in order of time and of timers up to the last input."""
        for ts, events in ticks:
            yield from self.due(ts)
            yield ts, self.tick(ts, events)
        if not self.began:
            yield 0, self.tick(0, {})

    def tick(self, ts: int, events: dict[int, Any]) -> dict[int, Any]:
        """Evaluate one tick; ``events`` by node id. Returns the events of the nodes that have one."""
        self.now, self.began = ts, True
        fired = {i for i, at in self.timers.items() if at == ts}
        values = dict(events)
        for s, deps in self.steps:
            value = self._value(s, deps, values, ts, fired)
            if value is not _ABSENT:
                values[s.id] = value
        for i in self.sampled:
            if i in values:
                self.current[i] = values[i]
        for s, (d, r) in self.delays:
            if s.id in fired or r in values:
                self.timers.pop(s.id, None)
                if d in values:
                    wait = values[d]
                    if isinstance(wait, Fault):
                        raise wait
                    if wait <= 0:
                        raise Fault(f"A delay must be positive, not {wait} (at {ts})")
                    self.timers[s.id] = ts + wait
        for s in self.periods:
            if s.id in fired:
                self.timers[s.id] = ts + s.every
        return values

    def _value(self, s: g.Stream, deps: list[int], values: dict[int, Any], ts: int, fired: set[int]) -> Any:
        kind = type(s)
        if kind is g.Lift:
            if not any(d in values for d in deps):
                return _ABSENT
            try:
                out = evaluate(s.body, {i: Some(values[d]) if d in values else None for i, d in enumerate(deps)})
            except Fault as fault:
                return fault
            return _ABSENT if out is None else out.value
        if kind is g.SignalLift:
            if not any(d in values for d in deps):
                return _ABSENT
            args = {}
            for i, d in enumerate(deps):
                x = values.get(d, self.current.get(d, _ABSENT))
                if x is _ABSENT:
                    return _ABSENT
                args[i] = x
            try:
                return evaluate(s.body, args)
            except Fault as fault:
                return fault
        if kind is g.Last:
            return self.current.get(deps[0], _ABSENT) if deps[1] in values else _ABSENT
        if kind is g.On:
            return values.get(deps[1], self.current.get(deps[1], _ABSENT)) if deps[0] in values else _ABSENT
        if kind is g.Merge:
            return next((values[d] for d in deps if d in values), _ABSENT)
        if kind is g.Time:
            return ts if deps[0] in values else _ABSENT
        if kind is g.Const:
            return s.value.value if deps[0] in values else _ABSENT
        if kind is g.Default:
            return values.get(deps[0], s.value.value if ts == 0 else _ABSENT)
        if kind is g.DefaultFrom:
            v = values.get(deps[0], _ABSENT)
            if v is _ABSENT and not self.memory.get(s.id):
                v = values.get(deps[1], _ABSENT)
            if v is not _ABSENT:
                self.memory[s.id] = True
            return v
        if kind in (g.Delay, g.Period):
            return NOTHING if s.id in fired else _ABSENT
        if kind is g.Fold:
            return self._fold(s, deps[0], values, ts)
        if kind is g.Collected:
            return self._collected(s, deps, values, ts)
        return _ABSENT

    def _collected(self, s: g.Collected, deps: list[int], values: dict[int, Any], ts: int) -> Any:
        before = self.memory.get(s.id, _ABSENT)
        if ts == 0 and (s.kind != "count" or deps[0] not in values):
            out = s.empty()
        elif deps[-1] not in values:
            return _ABSENT
        else:
            before = s.empty() if before is _ABSENT else before
            x, n = values.get(deps[0], self.current.get(deps[0], _ABSENT)), values[deps[-1]]
            if x is _ABSENT:
                return _ABSENT
            fault = next((y for y in (before, x, n) if isinstance(y, Fault)), None)
            out = fault or s.add(before, x, n)
        self.memory[s.id] = out
        return out

    def _fold(self, s: g.Fold, d: int, values: dict[int, Any], ts: int) -> Any:
        before = self.memory.get(s.id, _ABSENT)
        if d in values:
            if before is _ABSENT and s.init is None:
                value = values[d]
            else:
                try:
                    value = evaluate(s.body, {0: s.init.value if before is _ABSENT else before, 1: values[d]})
                except Fault as fault:
                    value = fault
        elif ts == 0 and s.init is not None:
            value = s.init.value
        else:
            return _ABSENT
        self.memory[s.id] = value
        return value


class _Absent:
    """No event (None is a value: the option that has none)."""

    def __repr__(self) -> str:
        return "no event"

    def __reduce__(self) -> str:
        return "_ABSENT"


_ABSENT = _Absent()

