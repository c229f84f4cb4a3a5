"""Lexical forms: source values as text, percent-encoding, literal escaping, lexical forms of datatypes. All native column expressions."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import XSD


def py_float(x: Column) -> Column:
    """A double as the shortest text that reads back, without an exponent from 1e-4 to 1e16."""
    s = x.cast("string")
    # From 1e-4 to 1e-3 Java writes an exponent of -4; the digits are taken as they are, for a decimal has fewer.
    digits = F.regexp_replace(F.regexp_replace(F.split(s, "E")[0], r"[-.]", ""), r"0+$", "")
    small = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("0.000"), digits)
    plain = F.regexp_replace(F.regexp_replace(s.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ".0")
    sign = F.when(F.abs(x) < 1, F.lit("e-")).otherwise(F.lit("e+"))
    exponent = F.abs(F.regexp_extract(s, r"E(-?\d+)", 1).try_cast("int")).cast("string")
    power = F.concat(F.regexp_replace(F.split(s, "E")[0], r"\.0$", ""), sign, F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent))
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when(~s.contains("E"), s)
        .when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e-3), small)
        .when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e16), plain)
        .otherwise(power)
    )


def lexical(x: Column, kind: T.DataType) -> Column:
    """Text of a source value of a type; null stays null."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return x.cast("string")
    if isinstance(kind, T.BooleanType):
        return F.initcap(x.cast("string"))
    if isinstance(kind, T.DoubleType):
        return py_float(x)
    if isinstance(kind, T.FloatType):
        return py_float(x.cast("string").cast("double"))
    if isinstance(kind, T.BinaryType):
        return F.hex(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        s = x.cast("string")
        return F.when(s.contains("."), F.concat(F.split(s, r"\.")[0], F.lit("."), F.rpad(F.split(s, r"\.")[1], 6, "0"))).otherwise(s)
    if isinstance(kind, T.ArrayType):
        own = F.transform(x, lambda e: lexical(e, kind.elementType))
        if isinstance(kind.elementType, T.StringType):
            own = F.transform(own, lambda e: F.concat(F.lit("'"), e, F.lit("'")))
        return F.concat(F.lit("["), F.array_join(own, ", ", "None"), F.lit("]"))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(x)
    return x.cast("string")


def encode_iri(x: Column, safe: str = "") -> Column:
    """Percent-encoding of all but RFC 3986 unreserved characters, and those of safe."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for c in safe:
        if (code := quote(c, safe="")) != c:
            out = F.replace(out, F.lit(code), F.lit(c))
    return out


ESCAPES = {"\n": "\\n", "\r": "\\r", '"': '\\"', "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def escape_literal(x: Column, chars: tuple[str, ...] = ('"', "\n", "\r")) -> Column:
    """Backslash first, then line ends, quotes and any further characters given."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in dict.fromkeys(("\n", "\r", '"', *chars)):
        if c and c != "\\":
            out = F.replace(out, F.lit(c), F.lit(ESCAPES.get(c, "\\" + c)))
    return out


def strip_ends(x: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def printable(x: Column) -> Column:
    """Without characters of Unicode's Other and Separator classes, except the blank."""
    return F.regexp_replace(x, r"[\p{C}\p{Z}&&[^ ]]", "")


def datatype_form(x: Column, datatype: str | None) -> Column:
    """The form a constant datatype wants."""
    if datatype == XSD + "boolean":
        return F.lower(x)
    if datatype == XSD + "dateTime":
        return F.replace(x, F.lit(" "), F.lit("T"))
    if datatype in (XSD + "integer", XSD + "nonNegativeInteger"):
        # Beyond the digits a double holds, whole numbers stay as they are.
        return F.when(x.rlike(r"^\s*-?(0|[1-9]\d*)\s*$"), F.trim(x)).otherwise(_truncated(x))
    return x


def _truncated(x: Column) -> Column:
    d = x.cast("double")
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("string")
