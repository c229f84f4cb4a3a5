"""Hashes, code points, types, URLs, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lexical import encode_iri
from . import Value, fn


@fn("bi:hash", value="valueParameter")
def sha256(value: Value) -> Value:
    return Value(F.sha2(value.text, 256))


@fn("bi:hash_iri", value="valueParameter")
def hash_iri(value: Value) -> Value:
    return Value(F.concat(F.lit("http://example.com/ns#"), F.sha2(value.text, 256)))


@fn("grel:string_md5", value="valueParameter")
def md5(value: Value) -> Value:
    return Value(F.md5(value.text))


@fn("grel:string_sha1", value="valueParameter")
def sha1(value: Value) -> Value:
    return Value(F.sha1(value.text))


@fn("grel:unicodestring-s", value="valueParameter")
def code_points(value: Value) -> Value:
    return Value(F.transform(F.filter(F.split(value.text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("string")), True)


@fn("grel:other_type", value="p_any_e")
def other_type(value: Value) -> Value:
    return Value(F.when(value.col.isNotNull(), F.lit("list" if value.array else "str")))


@fn("idlab:toUpperCaseURL", value="str")
def upper_url(value: Value) -> Value:
    """The URL in upper case, its scheme kept, percent-encoded but for the characters that part a URL."""
    t = value.text
    scheme = F.regexp_extract(F.lower(t), r"^(https?://)", 1)
    rest = encode_iri(F.upper(t.substr(F.length(scheme) + 1, F.length(t))), "/?#=&:")
    return Value(F.concat(F.when(scheme == "", F.lit("http://")).otherwise(scheme), rest))


@fn("compat:idlab:toUpperCaseURL", value="str")
def old_upper_url(value: Value) -> Value:
    """As toUpperCaseURL, but of a URL with a scheme only the scheme is left, twice."""
    scheme = F.regexp_extract(F.lower(value.text), r"^(https?://)", 1)
    return Value(F.when(scheme == "", F.concat(F.lit("http://"), encode_iri(F.upper(value.text)))).otherwise(F.concat(scheme, encode_iri(F.upper(scheme)))))


@fn("bi:uuid")
def uuid() -> Value:
    return Value(F.expr("uuid()"))


@fn("bi:other_coalesce", values="p_any_rep_e")
def coalesce(values: Value) -> Value:
    return Value(F.get(F.filter(values.items, lambda x: x.isNotNull() & (x != "")), 0))
