"""String functions."""

from __future__ import annotations

import html
import json
import re
from urllib.parse import unquote
from xml.sax.saxutils import unescape as xml_unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.lexical import encode_iri, py_float
from . import Value, fn, python


def _bool(x: Column) -> Column:
    return F.when(x, "true").otherwise("false")


def quoted(sep: Value) -> Column:
    """A pattern that matches the text itself."""
    if sep.constant is not None:
        return F.lit(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", sep.constant))
    return F.regexp_replace(sep.text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _chain(x: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@fn("grel:escape", value="valueParameter", mode="modeParameter")
def escape(value: Value, mode: Value) -> Value:
    x, how = value.text, F.lower(mode.text)
    markup = _chain(x, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    csv = F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    script = _chain(x, ("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
    ways = {"html": _chain(markup, ('"', "&quot;"), ("'", "&#x27;")), "xml": markup, "url": encode_iri(x, "/"), "javascript": script, "csv": csv}
    if mode.constant is not None:
        if mode.constant.lower() not in ways:
            raise ValueError(f"unknown mode of escaping {mode.constant!r}")
        return Value(ways[mode.constant.lower()])
    out = F.when(F.lit(False), x)
    for k, v in ways.items():
        out = out.when(how == k, v)
    return Value(out)


def _unescape(text: str, mode: str):
    match mode.lower():
        case "html":
            return html.unescape(text)
        case "xml":
            return xml_unescape(text, {"&quot;": '"', "&apos;": "'"})
        case "url":
            return unquote(text)
        case "javascript":
            return json.loads('"' + re.sub(r"\\'", "'", text).replace('"', '\\"').replace('\\\\"', '\\"') + '"')
    raise ValueError(f"unknown mode of unescaping {mode!r}")


@fn("grel:string_unescape", value="valueParameter", mode="modeParameter")
def string_unescape(value: Value, mode: Value) -> Value:
    return Value(python(_unescape, value.text, mode.text))


@fn("grel:string_contains", value="valueParameter", part="string_sub")
def string_contains(value: Value, part: Value) -> Value:
    return Value(_bool(value.text.contains(part.text)))


@fn("grel:string_startsWith", value="valueParameter", part="string_sub")
def starts_with(value: Value, part: Value) -> Value:
    return Value(_bool(value.text.startswith(part.text)))


@fn("grel:string_endsWith", value="valueParameter", part="string_sub")
def ends_with(value: Value, part: Value) -> Value:
    return Value(_bool(value.text.endswith(part.text)))


@fn("grel:string_indexOf", value="valueParameter", part="string_sub")
def index_of(value: Value, part: Value) -> Value:
    return Value((F.call_function("locate", part.text, value.text) - 1).cast("string"))


@fn("grel:string_lastIndexOf", value="valueParameter", part="string_sub")
def last_index_of(value: Value, part: Value) -> Value:
    at = F.call_function("locate", F.reverse(part.text), F.reverse(value.text))
    return Value(F.when(at == 0, F.lit(-1)).otherwise(F.length(value.text) - F.length(part.text) - at + 1).cast("string"))


@fn("grel:string_toNumber", value="p_any_e")
def to_number(value: Value) -> Value:
    return Value(py_float(F.nullif(F.trim(value.text), F.lit("")).cast("double")))


@fn("grel:string_toString", value="p_any_e")
def to_string(value: Value) -> Value:
    return Value(value.col, value.array)


@fn("grel:string_diff", prefix="valueParameter", value="valueParameter2")
def diff(prefix: Value, value: Value) -> Value:
    """The second text without the first, where it begins with it."""
    return Value(F.when(value.text.startswith(prefix.text), value.text.substr(F.length(prefix.text) + 1, F.length(value.text))).otherwise(value.text))


@fn("grel:string_length", value="valueParameter")
def length(value: Value) -> Value:
    return Value(F.length(value.text).cast("string"))


@fn("grel:string_splitByLengths", value="valueParameter", first="p_int_i", second="p_int_i2", more="p_rep_i")
def split_by_lengths(value: Value, first: Value, second: Value | None = None, more: Value | None = None) -> Value:
    """Consecutive parts of the given lengths."""
    at, parts = F.lit(1), []
    for v in [x for x in (first, second) if x is not None] + ([more] if more is not None and not more.array else []):
        n = v.text.cast("double").cast("int")
        parts.append(value.text.substr(at, n))
        at = at + n
    return Value(F.filter(F.array(*parts), lambda x: x != ""), True)


@fn("grel:string_split", "bi:string_split_explode", value="valueParameter", separator="p_string_sep")
def split(value: Value, separator: Value) -> Value:
    return Value(F.split(value.text, quoted(separator)), True)


@fn("grel:string_smartSplit", value="valueParameter", separator="p_opt_sep")
def smart_split(value: Value, separator: Value | None = None) -> Value:
    if separator is not None:
        return split(value, separator)
    t = value.text
    return Value(F.when(t.contains("\t"), F.split(t, "\t")).when(t.contains(","), F.split(t, ",")).otherwise(F.array(t)), True)


@fn("grel:string_substring", value="valueParameter", start="param_int_i_from", end="param_int_i_opt_to")
def substring(value: Value, start: Value, end: Value | None = None) -> Value:
    t, n = value.text, F.length(value.text)
    lo = start.text.cast("double").cast("int")
    hi = F.when(F.coalesce(F.trim(end.text), F.lit("")) == "", F.lit(0)).otherwise(end.text.try_cast("double").cast("int")) if end else F.lit(0)
    a = F.greatest(F.when(lo < 0, lo + n).otherwise(lo), F.lit(0))
    b = F.when(hi == 0, n).when(hi < 0, hi + n).otherwise(F.least(hi, n))
    return Value(t.substr(a + 1, F.greatest(b - a, F.lit(0))))


@fn("grel:string_splitByCharType", value="valueParameter")
def split_by_char_type(value: Value) -> Value:
    return Value(F.regexp_extract_all(value.text, F.lit(r"\d|\s|[a-z]+|[A-Z]+"), F.lit(0)), True)


def _parted(value: Value, fragment: Value, omit: Value | None, at: Column) -> Value:
    t, f = value.text, fragment.text
    before, after = t.substr(F.lit(1), at - 1), t.substr(at + F.length(f), F.length(t))
    whole = F.array(before, f, after)
    found = F.when(F.lower(omit.text) == "true", F.array(before, after)).otherwise(whole) if omit else whole
    return Value(F.when(at > 0, found).otherwise(F.array(F.lit(""), t)), True)


@fn("grel:string_partition", value="valueParameter", fragment="p_fragment", omit="p_bool_opt_b")
def partition(value: Value, fragment: Value, omit: Value | None = None) -> Value:
    return _parted(value, fragment, omit, F.call_function("locate", fragment.text, value.text))


@fn("grel:string_rpartition", value="valueParameter", fragment="p_fragment", omit="p_bool_opt_b")
def rpartition(value: Value, fragment: Value, omit: Value | None = None) -> Value:
    back = F.call_function("locate", F.reverse(fragment.text), F.reverse(value.text))
    return _parted(value, fragment, omit, F.when(back > 0, F.length(value.text) - F.length(fragment.text) - back + 2).otherwise(F.lit(0)))


@fn("grel:string_chomp", value="valueParameter", separator="p_string_sep")
def chomp(value: Value, separator: Value) -> Value:
    t, s = value.text, separator.text
    return Value(F.when((s != "") & t.endswith(s), t.substr(F.lit(1), F.length(t) - F.length(s))).otherwise(t))


@fn("grel:reverse", value="valueParameter")
def reverse(value: Value) -> Value:
    return Value(F.reverse(value.text))


@fn("grel:string_replace", "grel:string_replaceChars", value="valueParameter", old="p_string_find", new="p_string_replace")
def replace(value: Value, old: Value, new: Value) -> Value:
    return Value(F.replace(value.text, old.text, new.text))


def _findall(text: str, pattern: str):
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        pattern = pattern[1:-1]
    return re.findall(pattern, text)


@fn("grel:string_match", value="valueParameter", pattern="p_string_regex")
def match(value: Value, pattern: Value) -> Value:
    return Value(python(_findall, value.text, pattern.text, array=True), True)


@fn("bi:concat", first="valueParameter1", second="valueParameter2", separator="p_string_sep")
def concat(first: Value, second: Value, separator: Value | None = None) -> Value:
    return Value(F.concat(first.text, separator.text if separator else F.lit(""), second.text))


@fn("grel:string_trim", value="valueParameter")
def trim(value: Value) -> Value:
    return Value(strip(value.text))


@fn("grel:toLowerCase", value="valueParameter")
def lower(value: Value) -> Value:
    return Value(F.lower(value.text))


@fn("grel:toUpperCase", value="valueParameter")
def upper(value: Value) -> Value:
    return Value(F.upper(value.text))


@fn("grel:string_toTitlecase", value="valueParameter")
def title(value: Value) -> Value:
    return Value(python(str.title, value.text))
