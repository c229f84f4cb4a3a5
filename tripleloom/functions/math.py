"""Mathematical functions. Numbers come as text; results are whole where the operation keeps whole numbers whole."""

from __future__ import annotations

import math as m

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.lexical import py_float
from . import Value, fn, python
from .arrays import as_items

WHOLE = r"^\s*[+-]?\d+\s*$"


def num(v: Value) -> Column:
    return F.trim(v.text).try_cast("double")


def is_whole(*vs: Value) -> Column:
    out = F.lit(True)
    for v in vs:
        out = out & v.text.rlike(WHOLE)
    return out


def whole(x: Column) -> Column:
    return x.cast("decimal(38,0)").cast("string")


def integer(v: Value) -> Column:
    return F.trim(v.text).try_cast("double").try_cast("long")


def _native(name: str, f) -> None:
    @fn(f"grel:math_{name}", value="p_dec_n")
    def build(value: Value) -> Value:
        return Value(py_float(f(num(value))))


def _libm(name: str, f) -> None:
    """The C library's result to the last digit, which the JVM's and numpy's differ from."""

    @fn(f"grel:math_{name}", value="p_dec_n")
    def build(value: Value) -> Value:
        return Value(python(lambda text: f(float(text)), value.text))


_native("degrees", F.degrees)
for _name in ("acos", "sin", "sinh", "tan", "tanh", "asin", "cos", "cosh", "atan", "exp"):
    _libm(_name, getattr(m, _name))
_libm("ln", m.log)
_libm("log", m.log10)


@fn("grel:math_radians", value="p_dec_n")
def radians(value: Value) -> Value:
    return Value(py_float(F.radians(num(value))))


@fn("grel:math_abs", value="p_dec_n")
def abs_(value: Value) -> Value:
    return Value(F.when(is_whole(value), whole(F.abs(F.trim(value.text).try_cast("decimal(38,0)")))).otherwise(py_float(F.abs(num(value)))))


@fn("grel:math_atan2", y="p_dec_n", x="param_n2")
def atan2(y: Value, x: Value) -> Value:
    return Value(python(lambda a, b: m.atan2(float(a), float(b)), y.text, x.text))


@fn("grel:math_ceil", value="p_dec_n")
def ceil(value: Value) -> Value:
    return Value(whole(F.ceil(num(value))))


@fn("grel:math_floor", value="p_dec_n")
def floor(value: Value) -> Value:
    return Value(whole(F.floor(num(value))))


@fn("grel:math_quotient", value="p_dec_n", by="param_n2")
def quotient(value: Value, by: Value) -> Value:
    return Value(whole(F.floor(num(value) / F.nullif(num(by), F.lit(0.0)))))


def _parity(x: Column, odd: int) -> Column:
    return F.initcap((F.pmod(F.floor(x), F.lit(2)) == odd).cast("string"))


@fn("grel:math_even", value="p_dec_n")
def even(value: Value) -> Value:
    return Value(_parity(num(value), 0))


@fn("grel:math_odd", value="p_dec_n")
def odd(value: Value) -> Value:
    return Value(_parity(num(value), 1))


@fn("grel:math_fact", value="p_int_i")
def fact(value: Value) -> Value:
    n = integer(value).try_cast("int")
    big = python(lambda t: m.factorial(int(float(t))) if float(t) >= 0 else None, F.when(n > 20, value.text))
    return Value(F.coalesce(F.factorial(F.when(n.between(0, 20), n)).cast("string"), big))


@fn("grel:math_factn", value="p_int_i", value2="p_int_i2")
def factn(value: Value, value2: Value) -> Value:
    """The product of the whole numbers from the lesser argument up to, not including, the greater."""
    return Value(python(lambda a, b: m.prod(range(min(int(float(a)), int(float(b))), max(int(float(a)), int(float(b))))), value.text, value2.text))


def _two(name: str, f) -> None:
    @fn(f"grel:math_{name}", value="p_int_i", value2="p_int_i2")
    def build(value: Value, value2: Value) -> Value:
        return Value(python(lambda a, b: f(int(float(a)), int(float(b))), value.text, value2.text))


_two("gcd", m.gcd)
_two("lcm", m.lcm)
_two("combin", lambda n, k: m.comb(n, k) if n >= 0 and k >= 0 else None)


@fn("grel:math_mod", value="p_int_i", value2="p_int_i2")
def mod(value: Value, value2: Value) -> Value:
    """With the sign of the divisor."""
    a, b = integer(value), F.nullif(integer(value2), F.lit(0).cast("long"))
    r = F.pmod(a, F.abs(b))
    return Value(F.when((b < 0) & (r != 0), r + b).otherwise(r).cast("string"))


@fn("grel:math_multinomial", values="p_array_a")
def multinomial(values: Value) -> Value:
    def f(items):
        own = [int(float(x)) for x in items]
        return m.factorial(sum(own)) // m.prod(map(m.factorial, own))

    return Value(python(f, as_items(values)))


@fn("grel:math_pow", value="p_dec_n", exponent="p_any_exp")
def pow_(value: Value, exponent: Value) -> Value:
    def power(a: str, b: str):
        r = float(a) ** float(b)
        return r if isinstance(r, float) else None

    return Value(python(power, value.text, exponent.text))


def _extreme(name: str, pick) -> None:
    @fn(f"grel:math_{name}", value="p_dec_n", value2="param_n2")
    def build(value: Value, value2: Value) -> Value:
        a, b = num(value), num(value2)
        best = pick(a, b)
        own = F.when(best == a, F.when(is_whole(value), F.trim(value.text)).otherwise(py_float(a))).otherwise(F.when(is_whole(value2), F.trim(value2.text)).otherwise(py_float(b)))
        return Value(F.when(a.isNotNull() & b.isNotNull(), own))


_extreme("max", F.greatest)
_extreme("min", F.least)


@fn("grel:math_randomNumber", low="p_int_i", high="p_int_i2")
def random_number(low: Value, high: Value) -> Value:
    return Value(py_float(F.rand() * (num(high) - num(low)) + num(low)))


@fn("grel:math_round", value="p_dec_n")
def round_(value: Value) -> Value:
    """Half to even. With a point, commas group thousands; without, a comma is the decimal sign."""
    t = F.trim(value.text)
    clean = F.when(t.contains(".") & t.contains(","), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return Value(whole(F.bround(clean.try_cast("double"), 0)))


