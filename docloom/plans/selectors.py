"""The selector language: `[a]`, `[^a]`, `[a=v]`, `[^a=v]`, joined by juxtaposition, with an optional `:phase`."""

from __future__ import annotations

import re
from dataclasses import dataclass

PHASES = ("start", "end", "item", "item-end")
_ATTRIBUTE = re.compile(r"\[(\^?)([-\w]+)(?:=(?:([-\w.+]+)|\"([^\"]*)\"))?\]")
_SELECTOR = re.compile(rf"((?:{_ATTRIBUTE.pattern})*)(?::([-\w]+))?")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


@dataclass(frozen=True)
class Test:
    name: str
    negated: bool
    #: None: the attribute's presence is tested.
    value: object = None

    def holds(self, schema: dict) -> bool:
        there = self.name in schema
        if self.value is None:
            return there != self.negated
        same = there and type(schema[self.name]) is not list and _same(schema[self.name], self.value)
        return not same if self.negated else same


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    return isinstance(a, str) == isinstance(b, str) and a == b


@dataclass(frozen=True)
class Selector:
    text: str
    tests: tuple[Test, ...]
    phase: str | None

    def matches(self, schema: dict, phase: str | None) -> bool:
        return phase == self.phase and all(t.holds(schema) for t in self.tests)


def is_selector(key: str) -> bool:
    return "[" in key or ":" in key


def value_of_literal(text: str):
    """A number if the text starts with one, then true and false, else the text."""
    if m := _NUMBER.match(text):
        number = float(m[0])
        return int(number) if number == int(number) else number
    return {"true": True, "false": False}.get(text, text)


def parse(text: str) -> Selector:
    m = _SELECTOR.fullmatch(text)
    if not m:
        raise ValueError(f"not a selector: {text!r}")
    tests = tuple(Test(name, bool(neg), quoted if quoted else value_of_literal(raw) if raw else None) for neg, name, raw, quoted in _ATTRIBUTE.findall(m[1]))
    return Selector(text, tests, m[m.lastindex] if text and ":" in text.rsplit("]", 1)[-1] else None)
