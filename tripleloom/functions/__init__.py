"""Built-in functions as column expressions, and functions of the user's own.

A builder takes its arguments by parameter name and gives a ``Value``. Every value is text or a list of text; a parameter bound more than once
is a list. Native expressions wherever Spark has the semantics; the rest are Arrow-batched Python.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import BUILT_IN, GREL, IDLAB, IDLAB_OLD


@dataclass
class Value:
    col: Column
    array: bool = False
    constant: str | None = None  # the text, where it is known when planning

    @property
    def text(self) -> Column:
        return F.element_at(self.col, 1) if self.array else self.col

    @property
    def items(self) -> Column:
        return self.col if self.array else F.array(self.col)


@dataclass
class Function:
    name: str
    params: dict[str, str]  # argument -> parameter name
    build: Callable[..., Value]


REGISTRY: dict[str, Function] = {}


def fn(*names: str, **params: str):
    """Register a builder. Names are ``grel:``, ``bi:`` (the engine's own name space) or ``idlab:``."""

    def register(build):
        for n in names:
            REGISTRY[n] = Function(n, params, build)
        return build

    return register


def local(iri: str) -> str:
    return iri.rsplit("#", 1)[-1].rsplit("/", 1)[-1].strip()


def short(iri: str) -> str:
    """The registry's name of a function IRI."""
    if iri.startswith(GREL):
        return "grel:" + local(iri)
    if BUILT_IN in iri:
        return "bi:" + iri.split(BUILT_IN, 1)[1]
    if iri.startswith((IDLAB, IDLAB_OLD)):
        return "idlab:" + local(iri)
    return iri


def python(f: Callable[..., Any], *cols: Column, array: bool = False) -> Column:
    """f over rows in Arrow batches: text or lists in, text (or a list) out. A null argument gives null, and so does one that isn't the number or date that f takes."""

    def run(*series: pd.Series) -> pd.Series:
        out = []
        for row in zip(*series):
            if any(x is None for x in row):
                out.append(None)
            else:
                try:
                    r = f(*row)
                except (ValueError, OverflowError, ZeroDivisionError):
                    r = None
                out.append(None if r is None else [None if e is None else str(e) for e in r] if array else str(r))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<string>" if array else "string")(*cols)


def load() -> dict[str, Function]:
    for m in ("arrays", "control", "dates", "math", "strings", "other"):
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY


def call(iri: str, args: list[tuple[str, Value]], udfs: dict | None = None, compat: bool = False) -> Value:
    """Evaluate a function. Built-in ones win over the user's. compat: the older results of those that have such (names ``compat:...``)."""
    by: dict[str, list[Value]] = {}
    for p, v in args:
        by.setdefault(local(p), []).append(v)

    def many(vs: list[Value]) -> Value:
        if len(vs) == 1:
            return vs[0]
        return Value(F.concat(*(v.items for v in vs)) if any(v.array for v in vs) else F.array(*(v.col for v in vs)), True)

    name = short(iri)
    own = load().get(f"compat:{name}" if compat and f"compat:{name}" in load() else name)
    if own:
        known = {p: a for a, p in own.params.items()}
        unknown = by.keys() - known.keys()
        if unknown:
            raise ValueError(f"{iri} has no parameter {sorted(unknown)}")
        return own.build(**{known[p]: many(v) for p, v in by.items()})
    user = (udfs or {}).get(iri)
    if user is None:
        raise ValueError(f"unknown function {iri}")
    from .udf import apply

    return apply(user, {p: many([v for q, v in args if q == p]) for p, _ in args})
