"""Term maps to column expressions: the serialized term, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions
from ..config import Config
from ..functions import Value
from ..mapping.rules import TermMap
from ..sources import col
from ..vocab import DEFAULT_GRAPH
from .lexical import datatype_form, encode_iri, escape_literal, printable, strip_ends

WRAP = {"IRI": ("<", ">"), "BlankNode": ("_:", ""), "Literal": ('"', '"')}


def joined(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def evaluate(m: TermMap, config: Config, udfs: dict, prefix: str = "") -> Value:
    """A function call, arguments first."""
    args = []
    for name, a in m.call.args:
        if a.kind == "function":
            args.append((name, evaluate(a, config, udfs, prefix)))
        else:
            parts = [col(prefix + t) if ref else F.lit(t) for t, ref in a.segments]
            args.append((name, Value(joined(parts), constant=a.value if a.kind == "constant" else None)))
    return functions.call(m.call.function, args, udfs, config.compat)


def body(m: TermMap, config: Config, prefix: str = "", value: Column | None = None) -> Column:
    """The term's text without its marks. value: the result of a function, for function-valued maps."""
    constant = m.datatype.value if m.datatype and m.datatype.kind == "constant" else None

    def of(x: Column, whole: bool) -> Column:
        if config.only_printable_chars:
            x = printable(x)
        if m.termtype == "IRI":
            return x if whole else encode_iri(x, config.safe_percent_encoding)
        if m.termtype == "Literal":
            return escape_literal(datatype_form(x, constant), config.literal_escaping_chars)
        return x

    if value is not None:
        return of(strip_ends(value) if m.termtype == "IRI" else value, True)
    if m.kind == "constant":
        return F.lit(m.value) if m.termtype != "Literal" else escape_literal(F.lit(m.value), config.literal_escaping_chars)
    whole = m.kind == "reference"
    return joined([of(col(prefix + t), whole) if ref else F.lit(t) for t, ref in m.segments])


def term(m: TermMap, config: Config, prefix: str = "", value: Column | None = None, tag: Column | None = None) -> Column:
    """The serialized term. tag: the result of a function that gives the language or datatype."""
    a, b = WRAP[m.termtype]
    parts = [F.lit(a), body(m, config, prefix, value), F.lit(b)]
    if m.termtype == "Literal":
        if m.lang:
            parts += [F.lit("@"), tag if tag is not None else body(TermMap(m.lang.kind, m.lang.value), config, prefix)]
        elif m.datatype:
            parts += [F.lit("^^<"), tag if tag is not None else body(TermMap(m.datatype.kind, m.datatype.value, "IRI"), config, prefix), F.lit(">")]
    return F.concat(*parts)


def graph(m: TermMap, config: Config, prefix: str = "", value: Column | None = None) -> Column:
    """The graph's term; null for the default graph."""
    if m.kind == "constant" and m.value == DEFAULT_GRAPH:
        return F.lit(None).cast("string")
    return term(m, config, prefix, value)


def is_injective(m: TermMap, safe: str = "") -> bool:
    """Whether different references give different terms: one reference, or references parted by characters that percent-encoding (but for the safe ones) removes from values."""
    if m.kind == "constant":
        return True
    if m.kind == "reference":
        return not m.lang and not (m.datatype and m.datatype.kind != "constant") and not (m.datatype and m.termtype == "Literal")
    if m.kind != "template" or m.lang or m.datatype:
        return False
    segments = m.segments
    refs = [k for k, (_, r) in enumerate(segments) if r]
    if len(refs) < 2:
        return True
    if m.termtype != "IRI":
        return False
    return all(any(not r and any(not (c.isalnum() and c.isascii()) and c not in "-._~%" + safe for c in t) for t, r in segments[a + 1 : b]) for a, b in zip(refs, refs[1:]))
