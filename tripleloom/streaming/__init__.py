"""Mapping streams: rules without joins are functions of a row and run on a streaming DataFrame.

Rules with joins, quoted statements or functions are refused. Statements that come again within the watermark are removed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..operators.lexical import lexical
from ..plans.compile import OUT, union
from ..sources import col


def stream_quads(spark: SparkSession, mapping: str, streams: dict[str, DataFrame], time: str, delay: str = "10 minutes", memory: dict[str, Any] | None = None) -> DataFrame:
    """(s, p, o, g, time) of streams named ``{name}`` in the mapping, each with the event-time column ``time``.

    Rules must be plain: their terms constants, references and templates.
    """
    engine = Engine(spark, mapping=mapping, memory=(memory or {}) | streams)
    c, parts = engine.compiler, []
    for g in engine.groups:
        for r in g:
            if not c.is_plain(r):
                raise ValueError(f"{r.triples_map}: only rules without joins, quoting or functions can be streamed")
            name = r.source.value.strip("{}")
            if name not in streams:
                raise ValueError(f"{r.triples_map}: {r.source.value} is no stream")
            references = r.references()
            df = streams[name].withWatermark(time, delay)
            kinds = {f.name: f.dataType for f in df.schema.fields}
            own = df.select(col(time).alias("time"), *(lexical(col(x), kinds[x]).alias(x) for x in references))
            own = own.where(c.present(own, references))
            parts.append(own.select(*c.columns(r), "time"))
    return union(parts).dropDuplicatesWithinWatermark(list(OUT))


