"""Functions of the user's own: a Python file that decorates them with ``@udf(fun_id=..., argument=parameter IRI, ...)``.

The file runs once on the driver, to learn names and parameters, and once in each Python worker.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from . import Value


def _decorator(table: dict):
    def udf(fun_id: str, **params: str):
        def register(f):
            table[fun_id] = (f, params)
            return f

        return register

    return udf


@lru_cache(8)
def run_source(source: str) -> dict:
    table: dict = {}
    exec(compile(source, "<udfs>", "exec"), {"udf": _decorator(table), "__name__": "udfs"})
    return table


def load_udfs(path: str) -> dict:
    """(source, fun_id, parameters) by function IRI."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    return {iri: (source, iri, params) for iri, (_, params) in run_source(source).items()}


def apply(user: tuple, args: dict[str, Value]) -> Value:
    """The result is a list for each row, as a function may give one value or several; None gives none."""
    source, iri, params = user
    names = [a for a, p in params.items() if p in args]

    def run(*series: pd.Series) -> pd.Series:
        f = run_source(source)[iri][0]
        out = []
        for row in zip(*series) if series else ():
            r = f(**{n: list(x) if hasattr(x, "tolist") else x for n, x in zip(names, row)})
            out.append(None if r is None else [None if e is None else str(e) for e in r] if isinstance(r, (list, tuple)) else [str(r)])
        return pd.Series(out, dtype=object)

    # A function without arguments is called with one that it doesn't see, once per row.
    if not names:
        def alone(s: pd.Series) -> pd.Series:
            f = run_source(source)[iri][0]
            results = [f() for _ in s]
            return pd.Series([None if r is None else [str(e) for e in r] if isinstance(r, (list, tuple)) else [str(r)] for r in results], dtype=object)

        return Value(F.pandas_udf(alone, "array<string>").asNondeterministic()(F.lit("")), True)
    cols = [args[params[n]].col for n in names]
    return Value(F.pandas_udf(run, "array<string>")(*cols), True)
