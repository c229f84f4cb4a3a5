"""Formats that Spark has no reader for: GeoParquet geometries, shapefiles, Feather, Stata, SAS, SPSS, spreadsheets. Single files, read by the driver, but for GeoParquet."""

from __future__ import annotations

import os
import re
import struct
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import Context, SourceError, col

# --- geometries


def _number(x: float) -> str:
    return f"{x:.15g}" if x != int(x) else str(int(x))


def wkt(data: bytes | None) -> str | None:
    """Text of a well-known-binary geometry."""
    return None if data is None else _wkt(bytes(data), 0)[0]


NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def _wkt(b: bytes, at: int) -> tuple[str, int]:
    order = "<" if b[at] else ">"
    (kind,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if kind & 0x20000000:
        at += 4
    dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
    kind &= 0x0FFFFFFF
    dims, kind = dims + {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000], kind % 1000
    tag = "" if dims == 2 else " Z" if dims == 3 else " ZM"

    def count():
        nonlocal at
        (n,) = struct.unpack_from(order + "I", b, at)
        at += 4
        return n

    def point():
        nonlocal at
        p = struct.unpack_from(order + "d" * dims, b, at)
        at += 8 * dims
        return " ".join(map(_number, p))

    def line():
        return "(" + ", ".join(point() for _ in range(count())) + ")"

    if kind == 1:
        body = f"({point()})"
    elif kind == 2:
        body = line()
    elif kind == 3:
        body = "(" + ", ".join(line() for _ in range(count())) + ")"
    elif kind in NAMES:
        parts = []
        for _ in range(count()):
            own, at = _wkt(b, at)
            parts.append(own if kind == 7 else own[own.index("(") :])
        if kind == 4:
            parts = [p.strip("()") for p in parts]
        body = "(" + ", ".join(parts) + ")"
    else:
        raise SourceError(f"unknown geometry {kind}")
    return (f"{NAMES[kind]}{tag} {body}" if body != "()" else f"{NAMES[kind]} EMPTY"), at


@F.pandas_udf(T.StringType())
def wkt_udf(s: pd.Series) -> pd.Series:
    return s.map(wkt)


def geoparquet(ctx: Context, path: str) -> DataFrame:
    df = ctx.spark.read.parquet(path)
    return df.select(*(wkt_udf(col(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else col(f.name) for f in df.schema.fields))


def _ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def _shape(b: bytes) -> str | None:
    (kind,) = struct.unpack_from("<i", b, 0)
    base = kind % 10
    text = lambda pts: "(" + ", ".join(f"{_number(x)} {_number(y)}" for x, y in pts) + ")"
    if kind == 0:
        return None
    if base == 1:
        return "POINT " + text([struct.unpack_from("<2d", b, 4)])
    if base == 8:
        (n,) = struct.unpack_from("<i", b, 36)
        return "MULTIPOINT " + text([struct.unpack_from("<2d", b, 40 + 16 * k) for k in range(n)])
    if base not in (3, 5):
        raise SourceError(f"unknown shape {kind}")
    parts, points = struct.unpack_from("<2i", b, 36)
    starts = [*struct.unpack_from(f"<{parts}i", b, 44), points]
    pts = [struct.unpack_from("<2d", b, 44 + 4 * parts + 16 * k) for k in range(points)]
    rings = [pts[a:z] for a, z in zip(starts, starts[1:])]
    if base == 3:
        return "LINESTRING " + text(rings[0]) if len(rings) == 1 else "MULTILINESTRING (" + ", ".join(map(text, rings)) + ")"
    polygons: list[list] = []
    for r in rings:
        if _ring_area(r) <= 0 or not polygons:  # clockwise: an outer ring
            polygons.append([r])
        else:
            polygons[-1].append(r)
    own = ["(" + ", ".join(map(text, p)) + ")" for p in polygons]
    return "POLYGON " + own[0] if len(own) == 1 else "MULTIPOLYGON (" + ", ".join(own) + ")"


def shapefile(ctx: Context, path: str) -> DataFrame:
    with open(path, "rb") as f:
        b = f.read()
    shapes, at = [], 100
    while at < len(b):
        (n,) = struct.unpack_from(">i", b, at + 4)
        shapes.append(_shape(b[at + 8 : at + 8 + 2 * n]))
        at += 8 + 2 * n
    with open(os.path.splitext(path)[0] + ".dbf", "rb") as f:
        d = f.read()
    many, head, width = struct.unpack_from("<IHH", d, 4)
    fields, at = [], 32
    while d[at] != 0x0D:
        fields.append((d[at : at + 11].split(b"\0")[0].decode(), chr(d[at + 11]), d[at + 16]))
        at += 32
    rows = []
    for k in range(many):
        at = head + k * width + 1
        row = []
        for _, _, size in fields:
            row.append(d[at : at + size].decode("utf-8", "replace").strip() or None)
            at += size
        rows.append((*row, shapes[k]))
    names = [n for n, _, _ in fields] + ["geometry"]
    return ctx.spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(len(names)))).toDF(*names)


# --- data files


def feather(ctx: Context, path: str) -> DataFrame:
    import pyarrow.feather as pf

    return ctx.spark.createDataFrame(pf.read_table(path))


def _pandas(ctx: Context, df: pd.DataFrame) -> DataFrame:
    df = df.copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = [None if v is None or v != v else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in df[c]]
    return ctx.spark.createDataFrame(df)


def stata(ctx: Context, path: str) -> DataFrame:
    return _pandas(ctx, pd.read_stata(path, **dict.fromkeys(("convert_categoricals", "preserve_dtypes", "convert_dates", "convert_missing"), False)))


def sas(ctx: Context, path: str) -> DataFrame:
    return _pandas(ctx, pd.read_sas(path, encoding="utf-8"))


def spss(ctx: Context, path: str) -> DataFrame:
    return _pandas(ctx, pd.read_spss(path))


# --- spreadsheets


def _rows(ctx: Context, rows: list[list[str | None]]) -> DataFrame:
    if not rows:
        raise SourceError("an empty sheet")
    names = [str(x) for x in rows[0] if x is not None]
    data = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:] if any(x is not None for x in r)]
    return ctx.spark.createDataFrame(data, ", ".join(f"c{k} string" for k in range(len(names)))).toDF(*names)


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def excel(ctx: Context, path: str) -> DataFrame:
    """The first sheet, as text."""
    if not path.lower().endswith(("xlsx", "xlsm")):
        df = pd.read_excel(path, dtype=str)
        return _pandas(ctx, df)
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(MAIN + "si")]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        root = ET.fromstring(z.read(sheets[0]))
    rows = []
    for r in root.iter(MAIN + "row"):
        own: list[str | None] = []
        for c in r.iter(MAIN + "c"):
            k = 0
            for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                k = k * 26 + ord(ch) - 64
            k = k - 1 if k else len(own)
            own += [None] * (k + 1 - len(own))
            v, kind = c.find(MAIN + "v"), c.get("t")
            if kind == "inlineStr":
                own[k] = "".join(t.text or "" for t in c.iter(MAIN + "t"))
            elif v is not None:
                own[k] = shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}[v.text] if kind == "b" else v.text
        rows.append(own)
    return _rows(ctx, rows)


TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def ods(ctx: Context, path: str) -> DataFrame:
    """The first sheet, as text."""
    if path.lower().endswith("fods"):
        root = ET.parse(path).getroot()
    else:
        with zipfile.ZipFile(path) as z:
            root = ET.fromstring(z.read("content.xml"))
    table = next(root.iter(TABLE + "table"))
    rows = []
    for r in table.iter(TABLE + "table-row"):
        own: list[str | None] = []
        for c in r:
            if c.tag != TABLE + "table-cell":
                continue
            text = "\n".join("".join(p.itertext()) for p in c.iter(TEXT + "p"))
            value = text or c.get(OFFICE + "value") or None
            repeat = int(c.get(TABLE + "number-columns-repeated", "1"))
            own += [value] * (repeat if value is not None or repeat < 100 else 1)
        while own and own[-1] is None:
            own.pop()
        rows += [own] * (int(r.get(TABLE + "number-rows-repeated", "1")) if own else 1)
    return _rows(ctx, [r for r in rows if r])
