"""The engine's interface: configurations or mapping text in, DataFrames of statements out."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import Any
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Source, load_config
from .functions.udf import load_udfs
from .mapping.normalize import MappingError, rewrite, to_rules
from .mapping.rules import DEFAULT, Rule, TermMap
from .mapping.yarrrml import load_yarrrml
from .plans.compile import Compiler
from .plans.partition import partition
from .rdf import Graph, Triple, parse_turtle, to_nt
from .sources import Context, source_type
from .sources.databases import table_types
from .vocab import HTV

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ROOT = str(Path(__file__).resolve().parents[1])


def _documents(spec: str) -> Iterator[tuple[str, str]]:
    """(name, text) of a mapping file, folder or URL."""
    if spec.startswith(("http://", "https://")):
        with urlopen(spec, timeout=60) as r:  # noqa: S310
            yield spec, r.read().decode()
    elif os.path.isdir(spec):
        for name in sorted(os.listdir(spec)):
            if os.path.isfile(path := os.path.join(spec, name)):
                yield from _documents(path)
    else:
        with open(spec, encoding="utf-8") as f:
            yield spec, f.read()


def parse_mapping(text: str, name: str = "", scope: str = "") -> list[Triple]:
    """Mapping triples of a Turtle or YARRRML document, told apart by the name's ending, else by what reads."""
    if name.lower().endswith((".yml", ".yaml", ".yarrrml")):
        return load_yarrrml(text)
    if name.lower().endswith((".ttl", ".nt", ".rml", ".r2rml")):
        return parse_turtle(text, scope=scope)
    try:
        return parse_turtle(text, scope=scope)
    except ValueError:
        return load_yarrrml(text)


def mapping_triples(config: Config, texts: dict[str, str] | None = None) -> dict[str, list[Triple]]:
    """By section; texts: mapping text of sections that have it in place of files."""
    out: dict[str, list[Triple]] = {}
    for k, (name, section) in enumerate(config.sources.items()):
        own: list[Triple] = []
        if texts and name in texts:
            own += parse_mapping(texts[name], scope=f"d{k}")
        else:
            for j, (doc, text) in enumerate(d for spec in section.mappings for d in _documents(spec)):
                own += parse_mapping(text, doc, f"d{k}_{j}")
        out[name] = own
    return out


def http_sources(by_section: dict[str, list[Triple]]) -> dict[str, dict]:
    """Requests by source name: path, parameters and headers."""
    out: dict[str, dict] = {}
    for triples in by_section.values():
        g = Graph(triples)
        for s, p, o in g.triples:
            if str(p) == HTV + "absolutePath":
                api = {"url": getattr(o, "value", str(o)), "headers": {}, "params": {}}
                for kind, where in (("headers", "headers"), ("params", "params"), ("parameters", "params")):
                    for h in g.objects(s, HTV + kind):
                        name, value = g.first(h, HTV + "fieldName") or g.first(h, HTV + "paramName"), g.first(h, HTV + "fieldValue") or g.first(h, HTV + "paramValue")
                        if name is not None:
                            api[where][getattr(name, "value", str(name))] = getattr(value, "value", str(value))
                out[str(s)] = api
    return out


def infer_datatypes(rules: list[Rule], ctx: Context) -> list[Rule]:
    """Datatypes of literal references of database tables, from the tables' columns."""
    out, known = [], {}
    for r in rules:
        o = r.object
        if o and o.kind == "reference" and o.termtype == "Literal" and not o.lang and not o.datatype and source_type(r.source, ctx) in ("database", "table"):
            if r.source not in known:
                known[r.source] = {k.lower(): v for k, v in table_types(ctx, r.source).items()} if r.source.kind == "tableName" else _query_types(ctx, r)
            if x := known[r.source].get(o.value.lower()):
                r = r.with_(object=TermMap(o.kind, o.value, o.termtype, datatype=TermMap("constant", x), joins=o.joins))
        out.append(r)
    return out


def _query_types(ctx: Context, r: Rule) -> dict[str, str | None]:
    from .sources import schema_of
    from .sources.databases import xsd_of

    schema = schema_of(r.source, ctx)
    return {f.name.lower(): xsd_of(f.dataType.simpleString()) for f in schema.fields if f.dataType.simpleString() != "string"} if schema else {}


class Engine:
    """A compiled configuration.

    >>> Engine(spark, config="config.ini").triples().write.parquet(...)
    >>> Engine(spark, mapping=turtle_or_yarrrml, memory={"people": df}).quads()
    """

    def __init__(self, spark: SparkSession, config: str | Config | None = None, mapping: str | None = None, memory: dict[str, Any] | None = None, keys: dict[str, set[str]] | None = None, base: str = "", **options):
        env = spark.sparkContext.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
        if spark.conf.get(ADVISORY) in ("64MB", "67108864b"):  # its default: after text is unpacked, sorted and hashed, gigabytes a task
            spark.conf.set(ADVISORY, "16MB")
        self.spark = spark
        self.config = config if isinstance(config, Config) else load_config(config) if config else Config(sources={"default": Source("default")})
        for k, v in options.items():
            if k in ("db_url", "file_path"):
                for s in self.config.sources.values():
                    setattr(s, k, v)
            elif hasattr(self.config, k):
                setattr(self.config, k, v)
            else:
                raise TypeError(f"unknown option {k}")
        by_section = mapping_triples(self.config, {"default": mapping} if mapping is not None else None)
        self.ctx = Context(spark, self.config, dict(memory or {}), http=http_sources(by_section), base=base)
        self.triples_in = by_section
        rules = to_rules(by_section, self.config.self_join_elimination)
        if self.config.infer_sql_datatypes:
            rules = infer_datatypes(rules, self.ctx)
        self.udfs = load_udfs(self.config.udfs) if self.config.udfs else {}
        self.rules = rules
        asserted = [r for r in rules if r.asserted and r.predicate is not None]
        self.groups = partition(asserted, self.config.mapping_partitioning, rules)
        self.compiler = Compiler(self.ctx, rules, self.udfs, {k: set(v) for k, v in (keys or {}).items()})

    def quads(self) -> DataFrame:
        """(s, p, o, g) serialized terms, no row twice; g is null in the default graph."""
        return self.compiler.compile(self.groups)

    def triples(self) -> DataFrame:
        """(s, p, o), the graphs merged."""
        out = self.quads().select("s", "p", "o")
        default = all(r.graph == DEFAULT for g in self.groups for r in g)
        return out if default else out.dropDuplicates()

    def lines(self, quads: bool | None = None) -> DataFrame:
        """(triple): statements as text without the final point, by the configured format."""
        if self.config.output_format == "N-QUADS" if quads is None else quads:
            return self.quads().select(F.concat_ws(" ", "s", "p", "o", "g").alias("triple"))
        return self.triples().select(F.concat_ws(" ", "s", "p", "o").alias("triple"))

    def by_group(self) -> Iterator[tuple[str, DataFrame]]:
        """(group, statements): groups have no statement in common."""
        for g in self.groups:
            yield g[0].group, self.compiler.group(g)

    def count(self) -> int:
        return self.quads().count() if self.config.output_format == "N-QUADS" else self.triples().count()


def materialize(spark: SparkSession, config: str | Config, python_source: dict[str, Any] | None = None) -> DataFrame:
    """Statements of a configuration, as a DataFrame (s, p, o, g)."""
    return Engine(spark, config, memory=python_source).quads()


def materialize_set(spark: SparkSession, config: str | Config, python_source: dict[str, Any] | None = None) -> set[str]:
    """Statements as a set of text, fetched partition by partition."""
    return {r[0] for r in Engine(spark, config, memory=python_source).lines().toLocalIterator()}


def materialize_kafka(spark: SparkSession, config: str | Config, python_source: dict[str, Any] | None = None) -> None:
    from .sinks import write_kafka

    write_kafka(Engine(spark, config, memory=python_source))


def translate_to_rml(path_or_text: str) -> str:
    """A mapping document (R2RML, older vocabularies, YARRRML) in the current vocabulary, as N-Triples."""
    triples: list[Triple] = []
    if "\n" in path_or_text:
        triples = parse_mapping(path_or_text)
    else:
        for name, text in _documents(path_or_text):
            triples += parse_mapping(text, name)
    return "".join(f"{to_nt(s)} {to_nt(p)} {to_nt(o)} .\n" for s, p, o in rewrite(triples).triples)


__all__ = ["Engine", "MappingError", "materialize", "materialize_kafka", "materialize_set", "parse_mapping", "translate_to_rml"]
