"""Array functions. A list given as text (``['a', 'b']``) is read as a list."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.lexical import py_float
from . import Value, fn, python


def read_list(text: str):
    try:
        v = ast.literal_eval(text)
        return [str(x) for x in v] if isinstance(v, (list, tuple)) else None
    except (ValueError, SyntaxError):
        return None


def as_items(v: Value) -> Column:
    return v.col if v.array else python(read_list, v.col, array=True)


def _int(v: Value) -> Column:
    return v.text.cast("double").cast("int")


def _python_slice(text: str, lo: str, hi: str):
    own = read_list(text)
    return (own if own is not None else text)[int(float(lo)) : int(float(hi))]


def part(arr: Column, lo: Column, hi: Column) -> Column:
    """A list's part from lo (0-based) to hi, ends counted from the back where negative."""
    n = F.size(arr)
    a = F.greatest(F.when(lo < 0, lo + n).otherwise(lo), F.lit(0))
    b = F.least(F.when(hi < 0, hi + n).otherwise(hi), n)
    return F.slice(arr, a + 1, F.greatest(b - a, F.lit(0)))


@fn("grel:array_get", values="p_array_a", start="param_int_i_from", end="param_int_i_opt_to")
def array_get(values: Value, start: Value, end: Value | None = None) -> Value:
    if not values.array:
        if end is not None:
            def cut(t, lo, hi):
                r = _python_slice(t, lo, hi)
                return r if isinstance(r, list) else [r]

            return Value(python(cut, values.col, start.text, end.text, array=True), True)

        def at(t, lo):
            own = read_list(t)
            own = own if own is not None else t
            k = int(float(lo))
            return own[k] if -len(own) <= k < len(own) else None

        return Value(python(at, values.col, start.text))
    lo = _int(start)
    if end is not None:
        return Value(part(values.col, lo, _int(end)), True)
    return Value(F.when(lo < 0, F.get(values.col, F.size(values.col) + lo)).otherwise(F.get(values.col, lo)))


@fn("grel:array_slice", values="p_array_a", start="param_int_i_from", end="param_int_i_opt_to")
def array_slice(values: Value, start: Value, end: Value | None = None) -> Value:
    """The part as one text, written like a Python list."""
    if not values.array:
        return Value(python(lambda t, lo, hi: str(_python_slice(t, lo, hi)) if hi else str((read_list(t) or t)[int(float(lo)) :]), values.col, start.text, end.text if end else F.lit("")))
    own = part(values.col, _int(start), _int(end) if end else F.size(values.col))
    return Value(F.concat(F.lit("["), F.array_join(F.transform(own, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))


@fn("grel:array_length", values="p_array_a")
def array_length(values: Value) -> Value:
    return Value(F.size(as_items(values)).cast("string") if values.array else F.when(as_items(values).isNotNull(), F.size(as_items(values))).cast("string"))


@fn("grel:array_sum", values="p_array_a")
def array_sum(values: Value) -> Value:
    """Sum of the elements that are numbers; whole if they all are."""
    own = F.filter(F.transform(as_items(values), lambda x: F.trim(x)), lambda x: x.try_cast("double").isNotNull())
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x.try_cast("double"))
    return Value(F.when(F.forall(own, lambda x: x.rlike(r"^[+-]?\d+$")), total.cast("long").cast("string")).otherwise(py_float(total)))


@fn("grel:array_join", values="p_array_a", separator="p_string_sep")
def array_join(values: Value, separator: Value) -> Value:
    if not values.array:
        return values
    if separator.constant is not None:
        return Value(F.array_join(values.col, separator.constant))
    rest = F.slice(values.col, 2, F.greatest(F.size(values.col) - 1, F.lit(0)))
    return Value(F.aggregate(rest, F.get(values.col, 0), lambda a, x: F.concat(a, separator.text, x)))


@fn("grel:array_reverse", values="p_array_a")
def array_reverse(values: Value) -> Value:
    return Value(F.reverse(as_items(values)), True)


@fn("grel:array_uniques", values="p_array_a")
def array_uniques(values: Value) -> Value:
    return Value(F.array_distinct(as_items(values)), True)


@fn("grel:array_sort", values="p_array_a")
def array_sort(values: Value) -> Value:
    return Value(F.array_sort(as_items(values)), True)
