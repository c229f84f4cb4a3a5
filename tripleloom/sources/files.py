"""Delimited text."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import Context, col


def delimiter(header: str, references: list[str], path: str) -> str:
    """A tab for .tsv; the comma if it gives the references; else what the header line suggests."""
    if path.lower().endswith(".tsv"):
        return "\t"
    names = next(csv.reader([header], delimiter=","), [])
    if all(r in names for r in references):
        return ","
    for d in (";", "\t", "|", ":", " "):
        own = next(csv.reader([header], delimiter=d), [])
        if len(own) > 1 and all(r in own for r in references):
            return d
    try:
        return csv.Sniffer().sniff(header, delimiters=";,\t|:").delimiter
    except csv.Error:
        return ","


def csv_file(ctx: Context, path: str, references: list[str], sep: str | None = None, infer: bool = False) -> DataFrame:
    """All columns as text. Quoted line ends are part of a value, so a file is read as a whole; ``csv_multiline = no`` in its section lets Spark split files without them."""
    options = next((s.options for s in ctx.config.sources.values() if s.options.get("csv_multiline")), {})
    key = f"csv|{path}|{sep}|{infer}"
    if key not in ctx.tables:
        if sep is None:
            first = ctx.spark.read.text(path).head(1)
            sep = delimiter(first[0][0].lstrip("﻿") if first else "", references, path)
        many = options.get("csv_multiline", "yes").lower() not in ("no", "false", "0")
        df = ctx.spark.read.csv(path, header=True, sep=sep, inferSchema=infer, quote='"', escape='"', multiLine=many, emptyValue="", encoding="UTF-8")
        if not infer and "" not in ctx.config.na_values:  # the reader gives null for an empty field, which is text here unless it counts as no value
            df = df.select(*(F.coalesce(col(c), F.lit("")).alias(c) for c in df.columns))
        ctx.tables[key] = df
    return ctx.tables[key]
