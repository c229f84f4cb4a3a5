"""Rules to DataFrames of statements (s, p, o, g).

A rule is scan, null filter, (join), terms. Rules of one group may share statements and have their duplicates removed together; groups can't,
and are only united. Three shapes of plan are used:

* narrow: the columns that a rule needs, without duplicates, then terms. The shuffle moves column values, not statements. For a rule alone in
  its group whose terms differ wherever its columns do, and sources that read columns by themselves.
* stacked: one scan for all plain rules of a source; each row gives an array of statements, one per rule, which is exploded. Where all of a group are, statements stay columns until duplicates are removed (compact).
* joined: as narrow, for a referencing object map: only key and term columns go through the join, whose rows lose duplicates before terms are made.
* general: a rule by itself, for other joins, quoted statements and functions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mapping.rules import LogicalSource, Rule, TermMap
from ..operators.terms import evaluate, graph, is_injective, term
from ..sources import Context, NESTED, col, is_columnar, scan, source_type
from .partition import partition

OUT = ("s", "p", "o", "g")
NEVER_TYPED = {"", "nan", "NaN", "NA", "N/A", "n/a", "None", "none", "null", "NULL", "-"}
PARENT = "__parent_"
SMALL = 1_000_000  # bytes of a source's columns, as far as Spark knows them before it reads
UNKNOWN = 1 << 50
SCHEMA = "s string, p string, o string, g string"


@dataclass
class Compiler:
    ctx: Context
    rules: list[Rule]
    udfs: dict = field(default_factory=dict)
    keys: dict[str, set[str]] = field(default_factory=dict)  # declared unique columns, by source value

    def __post_init__(self):
        self.by_id = {r.id: r for r in self.rules}
        self.by_map: dict[str, Rule] = {}
        for r in self.rules:
            self.by_map.setdefault(r.triples_map, r)

    # --- rows

    def present(self, df: DataFrame, names: Iterable[str]) -> Column:
        """All of the columns have a value. Only text and floating-point columns are held against the NA values, unless those could be of another type."""
        na, out = self.ctx.config.na_values, F.lit(True)
        loose = not set(na) <= NEVER_TYPED
        for n in names:
            own = col(n).isNotNull()
            if na and (loose or not df.schema[n].metadata.get("typed")):
                own = own & ~col(n).isin(*na)
            out = out & own
        return out

    def rows(self, source: LogicalSource, references: list[str]) -> DataFrame:
        """Rows of a source that have a value for every reference."""
        df = scan(source, references, self.ctx)
        return df.where(self.present(df, references)) if references else df

    def quoted_references(self, r: Rule) -> list[str]:
        """References of a rule, and of the rules it quotes from the same row."""
        out = list(r.references())
        for m in (r.subject, r.object):
            if m and m.kind == "quoted" and not m.joins:
                out += self.quoted_references(self.by_id[m.value])
        return list(dict.fromkeys(out))

    # --- terms

    def with_functions(self, df: DataFrame, m: TermMap, name: str, prefix: str = "") -> tuple[DataFrame, Column | None, Column | None]:
        """Columns for a map's function value and the function of its language or datatype; lists give a row for each element, no value no row."""
        found: list[Column | None] = []
        for own, suffix in ((m, ""), (m.lang or m.datatype, "_tag")):
            if own is None or own.kind != "function":
                found.append(None)
                continue
            v = evaluate(own, self.ctx.config, self.udfs, prefix)
            c = f"__{name}{suffix}"
            df = df.withColumn(c, F.explode(v.col) if v.array else v.col)
            df = df.where(col(c).isNotNull() & ~col(c).isin(*self.ctx.config.na_values))
            found.append(col(c))
        return df, found[0], found[1]

    def statement(self, r: Rule, df: DataFrame, level: int = 0, prefix: str = "") -> DataFrame:
        """df with columns s, p, o, g of this nesting level; the source's columns stay, for quoting rules to join on."""
        config, at = self.ctx.config, f"{level}"
        for position in ("subject", "object", "predicate", "graph"):
            m = getattr(r, position)
            name = f"__{position[0]}{at}"
            if m.kind == "quoted":
                df = self.quote(r, m, df, name, level, prefix)
                continue
            if m.kind == "parent":
                df = self.parent(r, m, df, name)
                continue
            df, value, tag = self.with_functions(df, m, f"f{position[0]}{at}", prefix)
            make = graph(m, config, prefix, value) if position == "graph" else term(m, config, prefix, value, tag)
            df = df.withColumn(name, make)
        return df

    def quote(self, r: Rule, m: TermMap, df: DataFrame, name: str, level: int, prefix: str) -> DataFrame:
        q = self.by_id[m.value]
        mark = lambda at: F.concat_ws(" ", F.lit("<<"), col(f"__s{at}"), col(f"__p{at}"), col(f"__o{at}"), F.lit(">>"))
        if not m.joins:
            deep = f"{level}{name[2]}"
            return self.statement(q, df, deep, prefix).withColumn(name, mark(deep))
        references = list(dict.fromkeys(self.quoted_references(q) + [p for _, p in m.joins]))
        rows = self.rows(q.source, references).dropDuplicates()
        own = self.statement(q, rows).select(*(col(p).alias(f"__k{k}_{name}") for k, (_, p) in enumerate(m.joins)), mark(0).alias(name)).dropDuplicates()
        return self.join(df, own, [(prefix + c, f"__k{k}_{name}") for k, (c, _) in enumerate(m.joins)])

    def parent(self, r: Rule, m: TermMap, df: DataFrame, name: str) -> DataFrame:
        """Join with the parent's subject references and keys only."""
        p = self.by_map[m.value]
        keys = [k for _, k in m.joins]
        references = list(dict.fromkeys(p.subject.references() + keys))
        rows = self.rows(p.source, references)
        if p.subject.kind == "quoted":
            rows = self.rows(p.source, list(dict.fromkeys(self.quoted_references(p) + keys)))
            rows = self.quote(p, p.subject, rows.dropDuplicates(), "__t", 0, "")
            value = tag = None
            made = col("__t")
        else:
            rows, value, tag = self.with_functions(rows.dropDuplicates(references), p.subject, "fp")
            made = term(TermMap(p.subject.kind, p.subject.value, m.termtype or p.subject.termtype), self.ctx.config, "", value)
        own = rows.select(*(col(k).alias(f"__k{i}_{name}") for i, k in enumerate(keys)), made.alias(name)).dropDuplicates()
        return self.join(df, own, [(c, f"__k{i}_{name}") for i, (c, _) in enumerate(m.joins)])

    @staticmethod
    def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
        """An inner equi-join on text keys; the strategy is left to the optimizer, which knows the sizes."""
        condition = None
        for a, b in on:
            c = col(a) == col(b)
            condition = c if condition is None else condition & c
        return left.join(right, condition, "inner").drop(*(b for _, b in on))

    # --- rules

    @staticmethod
    def is_plain(r: Rule) -> bool:
        """No join, quoting or function: a function of the row."""
        return all(m.kind in ("constant", "template", "reference") and not any(x and x.kind == "function" for x in (m.lang, m.datatype)) for m in r.maps)

    def columns(self, r: Rule) -> list[Column]:
        config = self.ctx.config
        return [term(r.subject, config).alias("s"), term(r.predicate, config).alias("p"), term(r.object, config).alias("o"), graph(r.graph, config).alias("g")]

    def is_narrow(self, r: Rule) -> bool:
        """Plain, and different rows of its references are different statements."""
        maps = [r.subject, r.predicate, r.object, r.graph]
        return self.is_plain(r) and all(is_injective(m, self.ctx.config.safe_percent_encoding) for m in maps) and not self.ctx.config.only_printable_chars

    def unique(self, r: Rule) -> bool:
        """The subject holds a declared key of the source, so no two rows give one statement."""
        own = self.keys.get(r.source.value)
        return bool(own) and self.is_narrow(r) and own <= set(r.subject.references())

    def narrow(self, r: Rule) -> DataFrame:
        references = r.references()
        rows = self.rows(r.source, references)
        return (rows if self.unique(r) else rows.dropDuplicates()).select(*self.columns(r))

    def is_joined(self, r: Rule) -> bool:
        """A referencing object map between plain terms, and different rows of the term columns are different statements."""
        if r.object.kind != "parent" or self.ctx.config.only_printable_chars:
            return False
        maps = [r.subject, r.predicate, r.graph, self.parent_subject(r)]
        return all(m.kind in ("constant", "template", "reference") and is_injective(m, self.ctx.config.safe_percent_encoding) for m in maps)

    def parent_subject(self, r: Rule) -> TermMap:
        own = self.by_map[r.object.value].subject
        return TermMap(own.kind, own.value, r.object.termtype or own.termtype, own.call)

    def joined(self, r: Rule) -> DataFrame:
        m, config, made = r.object, self.ctx.config, self.parent_subject(r)
        own = list(dict.fromkeys(x for t in (r.subject, r.predicate, r.graph) for x in t.references()))
        theirs = made.references()
        keys = [k for _, k in m.joins]
        parent = self.rows(self.by_map[m.value].source, list(dict.fromkeys(theirs + keys)))
        parent = parent.select(*(col(k).alias(f"__key{i}") for i, k in enumerate(keys)), *(col(x).alias(PARENT + x) for x in theirs)).dropDuplicates()
        rows = self.join(self.rows(r.source, r.references()), parent, [(c, f"__key{i}") for i, (c, _) in enumerate(m.joins)])
        rows = rows.select(*(col(x) for x in own), *(col(PARENT + x) for x in theirs)).dropDuplicates()
        return rows.select(term(r.subject, config).alias("s"), term(r.predicate, config).alias("p"), term(made, config, PARENT).alias("o"), graph(r.graph, config).alias("g"))

    def constant(self, r: Rule) -> DataFrame:
        return self.ctx.spark.range(1).select(*self.columns(r))

    def general(self, r: Rule) -> DataFrame:
        references = self.quoted_references(r)
        if not references and self.is_plain(r):
            return self.constant(r)
        rows = self.spread(self.rows(r.source, references)) if any(m.kind == "function" for m in r.maps) else self.rows(r.source, references)
        return self.statement(r, rows).select(col("__s0").alias("s"), col("__p0").alias("p"), col("__o0").alias("o"), col("__g0").alias("g"))

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows of a function's arguments over many tasks: its lists, and the removal of their duplicates, may be many times what a task has read. Small sources stay as they are."""
        spark = self.ctx.spark
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if size < SMALL:
            return rows
        return rows.repartition(least if size >= UNKNOWN else max(least, size // SMALL))

    def stacked(self, rules: list[Rule]) -> DataFrame:
        """One scan, several statements a row."""
        references = list(dict.fromkeys(x for r in rules for x in r.references()))
        df = scan(rules[0].source, references, self.ctx)
        made = []
        for r in rules:
            own = F.struct(*self.columns(r))
            made.append(F.when(self.present(df, r.references()), own) if r.references() else own)
        out = df.select(F.explode(F.array(*made)).alias("t")).where("t is not null")
        return out.select(*(F.col("t")[c].alias(c) for c in OUT))

    def compact(self, rules: list[Rule]) -> DataFrame:
        """One scan, as stacked, without duplicates. A rule that can share no statement with the others, and whose terms differ wherever its columns do, has its columns
        go through the shuffle, with the rule's number; the others have their statements. Terms are made of the columns afterwards."""
        parts = partition(rules, all_rules=self.rules)
        single = {k: g[0] for k, g in enumerate(parts) if len(g) == 1 and self.is_narrow(g[0])}
        if not single:
            return self.stacked(rules).dropDuplicates()
        references = list(dict.fromkeys(x for r in rules for x in r.references()))
        df = scan(rules[0].source, references, self.ctx)
        width = max(len(OUT) if len(single) < len(parts) else 0, *(len(r.references()) for r in single.values()))
        made = []
        for k, g in enumerate(parts):
            for r in g:
                values = [col(x) for x in r.references()] if k in single else self.columns(r)
                own = F.struct(F.lit(k).alias("k"), *((values[j] if j < len(values) else F.lit(None).cast("string")).alias(f"v{j}") for j in range(width)))
                made.append(F.when(self.present(df, r.references()), own))
        rows = df.select(F.explode(F.array(*made)).alias("t")).where("t is not null").select("t.*").dropDuplicates()
        rows = rows.select("*", *(F.col(f"v{j}").alias(f"__{k}_{x}") for k, r in single.items() for j, x in enumerate(r.references())))
        out = []
        for at, name in enumerate(OUT):
            c = F.when(F.lit(False), F.lit(None).cast("string"))
            for k, r in single.items():
                m, pre = (r.subject, r.predicate, r.object, r.graph)[at], f"__{k}_"
                c = c.when(F.col("k") == k, graph(m, self.ctx.config, pre) if name == "g" else term(m, self.ctx.config, pre))
            out.append((c.otherwise(F.col(f"v{at}")) if len(single) < len(parts) else c).alias(name))
        return rows.select(*out)

    def group(self, rules: list[Rule]) -> DataFrame:
        """The statements of a group, without duplicates."""
        if len(rules) == 1:
            r = rules[0]
            if not self.quoted_references(r) and self.is_plain(r):
                return self.constant(r)
            if self.is_narrow(r):
                return self.narrow(r)
            if self.is_joined(r):
                return self.joined(r)
            return self.general(r).dropDuplicates()
        parts, stacks = [], {}
        for r in rules:
            if self.is_plain(r) and r.references():
                key = (r.source, tuple(r.references()) if source_type(r.source, self.ctx) in NESTED | {"memory"} else ())
                stacks.setdefault(key, []).append(r)
            else:
                parts.append(self.general(r))
        if not parts and len(stacks) == 1:
            return self.compact(rules)
        parts += [self.stacked(v) if len(v) > 1 else self.general(v[0]) for v in stacks.values()]
        return union(parts).dropDuplicates()

    def compile(self, groups: list[list[Rule]]) -> DataFrame:
        """All groups' statements. Groups of single plain rules over one text source are scanned together: parsing it again costs more than shuffling statements."""
        parts: list[DataFrame] = []
        together: dict[tuple, list[Rule]] = {}
        for g in groups:
            r = g[0]
            if len(g) == 1 and self.is_plain(r) and r.references() and not is_columnar(r.source, self.ctx) and source_type(r.source, self.ctx) not in NESTED | {"memory"}:
                together.setdefault((r.source,), []).append(r)
            else:
                parts.append(self.group(g))
        for v in together.values():
            if len(v) == 1:
                parts.append(self.group(v))
            elif all(self.unique(r) for r in v):
                parts.append(self.stacked(v))
            else:
                parts.append(self.stacked(v).dropDuplicates())
        return union(parts) if parts else self.ctx.spark.createDataFrame([], SCHEMA)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


