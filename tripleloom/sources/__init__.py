"""Logical sources to DataFrames of text columns named like the references."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..mapping.rules import LogicalSource
from ..operators.lexical import lexical
from ..vocab import RML


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Context:
    spark: SparkSession
    config: Config = field(default_factory=Config)
    memory: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)  # read once per source
    http: dict[str, dict] = field(default_factory=dict)
    base: str = ""  # what relative paths are relative to

    def path(self, text: str) -> str:
        return os.path.join(self.base, text) if self.base and not os.path.isabs(text) and "://" not in text and not text.startswith("{") else text


class SourceError(ValueError):
    pass


EXTENSIONS = {
    "csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "geoparquet": "geoparquet", "orc": "orc", "feather": "feather", "arrow": "feather", "dta": "stata", "xpt": "sas", "sas7bdat": "sas", "sav": "spss",
    "xls": "excel", "xlsx": "excel", "xlsm": "excel", "xlsb": "excel", "ods": "ods", "fods": "ods", "json": "json", "jsonl": "json", "ndjson": "json", "xml": "xml", "shp": "shapefile",
}
FORMULATIONS = {RML + "CSV": "csv", RML + "JSONPath": "json", RML + "XPath": "xml", RML + "GeoParquet": "geoparquet", RML + "Shapefile": "shapefile"}
NESTED = {"json", "xml", "memory-json", "http"}


def source_type(source: LogicalSource, ctx: Context) -> str:
    """The reader for a source: from the section's database, the kind of source, its extension or its reference formulation."""
    section = ctx.config.sources.get(source.section)
    if source.formulation == RML + "Cypher":
        return "cypher"
    if section and section.db_url and source.kind in ("tableName", "query"):
        return "database"
    if source.kind == "query":
        return "view"
    if source.kind == "tableName":
        return "table"
    value = file_of(source, ctx)
    if value.startswith("{") and value.endswith("}"):
        return "memory"
    if source.value in ctx.http:
        return "http"
    if source.formulation == RML + "GeoParquet":
        return "geoparquet"
    ext = os.path.splitext(urlparse(value).path.rstrip("/"))[1].lstrip(".").lower()
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    if source.formulation in FORMULATIONS:
        return FORMULATIONS[source.formulation]
    raise SourceError(f"can't tell the format of source {value!r}")


def file_of(source: LogicalSource, ctx: Context) -> str:
    section = ctx.config.sources.get(source.section)
    return ctx.path(section.file_path if section and section.file_path else source.value)


def texts(df: DataFrame, references: list[str]) -> DataFrame:
    """The references as text; columns that df lacks are null. Names match exactly, else without regard to case."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    lower = {n.lower(): n for n in kinds}

    def one(r: str) -> Column:
        name = r if r in kinds else lower.get(r.lower())
        if name is None:
            return F.lit(None).cast("string").alias(r)
        typed = not isinstance(kinds[name], (T.StringType, T.VarcharType, T.CharType, T.FloatType, T.DoubleType))
        return lexical(col(name), kinds[name]).alias(r, metadata={"typed": True} if typed else {})

    return df.select(*(one(r) for r in references))


def scan(source: LogicalSource, references: list[str], ctx: Context) -> DataFrame:
    """Rows of a source: one text column per reference, rows not yet filtered."""
    from . import binary, databases, files, http, memory, nested, views

    kind = source_type(source, ctx)
    if kind in ("json", "xml"):
        path = file_of(source, ctx)
        return (nested.json_file if kind == "json" else nested.xml_file)(ctx, path, source.iterator, references)
    if kind == "memory":
        return memory.read(ctx, source.value[1:-1], source.iterator, references)
    if kind == "http":
        return http.read(ctx, source, references)
    key = f"{source.section}|{source.kind}|{file_of(source, ctx)}|{kind}"
    if key not in ctx.tables:
        if kind == "csv":
            return texts(files.csv_file(ctx, file_of(source, ctx), references), references)
        if kind in ("parquet", "orc"):
            df = ctx.spark.read.format(kind).load(file_of(source, ctx))
        elif kind == "view":
            df = views.sql_view(ctx, source.value)
        elif kind == "table":
            df = ctx.spark.table(source.value)
        elif kind in ("database", "cypher"):
            df = getattr(databases, kind)(ctx, source)
        else:
            df = getattr(binary, kind)(ctx, file_of(source, ctx))
        ctx.tables[key] = df
    return texts(ctx.tables[key], references)


def is_columnar(source: LogicalSource, ctx: Context) -> bool:
    """Whether a scan reads only the columns it needs, so that scanning again is cheap."""
    return source_type(source, ctx) in ("parquet", "orc", "table", "geoparquet")


def schema_of(source: LogicalSource, ctx: Context) -> T.StructType | None:
    """The typed columns of a table source, for datatype inference."""
    if source_type(source, ctx) not in ("database", "table"):
        return None
    scan(source, [], ctx)
    return ctx.tables[f"{source.section}|{source.kind}|{file_of(source, ctx)}|{source_type(source, ctx)}"].schema
