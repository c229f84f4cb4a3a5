"""Control functions. Conditions that are not plain booleans are evaluated by a small expression evaluator, never by eval."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import Value, fn, python

COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}

YES, NO = ("1", "on", "true", "yes"), ("", "0", "no", "off", "false")


def evaluate(text: str):
    """Literals, comparisons, and/or/not and arithmetic; anything else is an error."""

    def ev(n):
        match n:
            case ast.Expression():
                return ev(n.body)
            case ast.Constant():
                return n.value
            case ast.Name() if n.id.lower() in ("true", "false"):
                return n.id.lower() == "true"
            case ast.List() | ast.Tuple():
                return [ev(x) for x in n.elts]
            case ast.UnaryOp(op=ast.Not()):
                return not ev(n.operand)
            case ast.UnaryOp(op=ast.USub()):
                return -ev(n.operand)
            case ast.BoolOp(op=ast.And()):
                return all(ev(x) for x in n.values)
            case ast.BoolOp(op=ast.Or()):
                return any(ev(x) for x in n.values)
            case ast.BinOp() if type(n.op) in ARITHMETIC:
                return ARITHMETIC[type(n.op)](ev(n.left), ev(n.right))
            case ast.Compare():
                left = ev(n.left)
                for op, right in zip(n.ops, n.comparators):
                    r = ev(right)
                    if not COMPARE[type(op)](left, r):
                        return False
                    left = r
                return True
        raise ValueError(f"not a condition: {text!r}")

    return ev(ast.parse(text.strip(), mode="eval"))


def _truth(text: str) -> str:
    try:
        return "true" if evaluate(text) else "false"
    except SyntaxError as e:
        raise ValueError(f"not a condition: {text!r}") from e


def condition(v: Value, true: tuple[str, ...] = ("true",), false: tuple[str, ...] = ("false",)) -> Column:
    low = F.lower(F.trim(v.text))
    if v.constant is not None and v.constant.strip().lower() in true + false:
        return F.lit(v.constant.strip().lower() in true)
    plain = F.when(low.isin(*true), F.lit(True)).when(low.isin(*false), F.lit(False))
    other = python(_truth, F.when(~low.isin(*true, *false), v.text))
    return F.coalesce(plain, other == "true")


@fn("grel:controls_if", test="bool_b", yes="any_true", no="any_false")
def controls_if(test: Value, yes: Value, no: Value) -> Value:
    return _choose(condition(test), yes, no)


@fn("bi:controls_if_cast", test="bool_b", yes="any_true", no="any_false")
def controls_if_cast(test: Value, yes: Value, no: Value) -> Value:
    return _choose(condition(test, YES, NO), yes, no)


def _choose(test: Column, yes: Value, no: Value) -> Value:
    if yes.array or no.array:
        return Value(F.when(test, yes.items).otherwise(no.items), True)
    return Value(F.when(test, yes.col).otherwise(no.col))


def _bool(x: Column) -> Column:
    return F.when(x, "true").otherwise("false")


def _is_true(x: Column) -> Column:
    return F.lower(x) == "true"


@fn("grel:boolean_and", values="param_rep_b")
def boolean_and(values: Value) -> Value:
    return Value(_bool(F.forall(values.items, _is_true)))


@fn("grel:boolean_or", values="param_rep_b")
def boolean_or(values: Value) -> Value:
    return Value(_bool(F.exists(values.items, _is_true)))


@fn("grel:boolean_xor", values="param_rep_b")
def boolean_xor(values: Value) -> Value:
    return Value(_bool(F.size(F.filter(values.items, _is_true)) % 2 == 1))


@fn("grel:boolean_not", value="bool_b")
def boolean_not(value: Value) -> Value:
    return Value(_bool(~_is_true(value.text)))


@fn("idlab:trueCondition", value="str", check="strBoolean")
def true_condition(value: Value, check: Value) -> Value:
    """The value where the check is true; else nothing, and the row gives no statement."""
    return Value(F.when(_is_true(check.text), value.col), value.array)
