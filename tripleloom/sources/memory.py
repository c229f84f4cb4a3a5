"""In-memory sources: Spark and pandas DataFrames, lists and tuples of rows, dictionaries and JSON text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import Context, SourceError, texts
from .nested import json_rows, json_text


def read(ctx: Context, name: str, iterator: str | None, references: list[str]) -> DataFrame:
    if name not in ctx.memory:
        raise SourceError(f"no in-memory source {name!r}")
    x = ctx.memory[name]
    if isinstance(x, (dict, str)):
        text = x if isinstance(x, str) else json.dumps(x)
        return json_rows(json_text(ctx, text), iterator, references)
    if isinstance(x, (list, tuple)):
        if x and isinstance(x[0], dict):
            return json_rows(json_text(ctx, json.dumps(x)), iterator or "$[*]", references)
        rows = [tuple(None if v is None else str(v) for v in (r if isinstance(r, (list, tuple)) else (r,))) for r in x]
        df = ctx.spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(len(references)))) if rows else ctx.spark.createDataFrame([], ", ".join(f"c{k} string" for k in range(len(references))))
        return df.toDF(*references)
    if not isinstance(x, DataFrame):
        own = x.copy()
        for c in own.columns:
            if own[c].dtype == object:
                own[c] = [None if v is None or v != v else str(v) for v in own[c]]
        x = ctx.spark.createDataFrame(own)
    out = texts(x, references)
    return out.select(*(F.regexp_replace(F.col("`" + r.replace("`", "``") + "`"), '^"(.*)"$', "$1").alias(r) for r in references))
