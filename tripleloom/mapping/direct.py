"""Direct mapping: a database schema to a mapping document.

A row's subject is ``<base>Table/key=value;...`` by its primary key, or a blank node where there is none. It has the
class ``<base>Table``, a literal ``<base>Table#column`` for each column that isn't null, and for each foreign key ``<base>Table#ref-columns``, the
subject of the row that it refers to.
"""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import SparkSession

from ..rdf import escape

ROW = "direct_row_id"


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    to: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    row_id: str = "monotonically_increasing_id()"  # SQL of a number for each row, for tables without a primary key


def sqlite_schema(path: str) -> list[Table]:
    """Tables of a SQLite file with their declared keys."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        out = []
        for (name,) in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\' order by name").fetchall():
            own = name.replace('"', '""')
            info = db.execute(f'PRAGMA table_info("{own}")').fetchall()
            key = tuple(r[1] for r in sorted((r for r in info if r[5]), key=lambda r: r[5]))
            refs: dict[int, list] = {}
            for r in db.execute(f'PRAGMA foreign_key_list("{own}")'):
                refs.setdefault(r[0], []).append(r)
            foreign = []
            for k in sorted(refs, reverse=True):
                rows = sorted(refs[k], key=lambda r: r[1])
                foreign.append(ForeignKey(tuple(r[3] for r in rows), rows[0][2], tuple(r[4] for r in rows if r[4])))
            out.append(Table(name, tuple(r[1] for r in info), key, tuple(foreign), "rowid"))
        by = {t.name: t for t in out}
        # A foreign key that names no columns refers to the primary key.
        return [Table(t.name, t.columns, t.primary_key, tuple(f if f.to else ForeignKey(f.columns, f.table, by[f.table].primary_key) for f in t.foreign_keys), t.row_id) for t in out]
    finally:
        db.close()


def catalog_schema(spark: SparkSession, keys: dict[str, tuple[str, ...]], foreign_keys: dict[str, list[ForeignKey]] | None = None) -> list[Table]:
    """Tables or views of the catalog; keys: the primary key of each, empty for none, as the catalog has none."""
    return [Table(n, tuple(spark.table(n).columns), tuple(k), tuple((foreign_keys or {}).get(n, ()))) for n, k in keys.items()]


def direct_mapping(tables: list[Table], base: str) -> str:
    """The mapping in Turtle."""
    iri = lambda *parts: f"<{base}" + "".join(parts) + ">"
    text = lambda x: '"' + escape(x) + '"'
    brace = lambda x: "{" + x.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}") + "}"
    q = lambda x: quote(x, safe="")
    by, out = {t.name: t for t in tables}, ["@prefix rml: <http://w3id.org/rml/> .\n"]
    for t in tables:
        if t.primary_key:
            source = f"[ rml:tableName {text(t.name)} ]"
            subject = f"rml:template {text(base.replace('{', '%7B') + q(t.name) + '/' + ';'.join(q(c) + '=' + brace(c) for c in t.primary_key))}"
        else:
            name = t.name.replace('"', '""') if t.row_id == "rowid" else t.name.replace("`", "``")
            mark = '"' if t.row_id == "rowid" else "`"
            source = f"[ rml:query {text(f'SELECT {t.row_id} AS {ROW}, * FROM {mark}{name}{mark}')} ]"
            subject = f"rml:template {text(q(t.name) + '_' + brace(ROW))} ; rml:termType rml:BlankNode"
        lines = [f"<#{q(t.name)}> rml:logicalSource {source} ; rml:subjectMap [ {subject} ; rml:class {iri(q(t.name))} ]"]
        lines += [f"rml:predicateObjectMap [ rml:predicate {iri(q(t.name), '#', q(c))} ; rml:objectMap [ rml:reference {text(c)} ] ]" for c in t.columns]
        for f in t.foreign_keys:
            if f.table not in by:
                raise ValueError(f"{t.name} refers to {f.table}, which isn't among the tables")
            joins = " , ".join(f"[ rml:child {text(a)} ; rml:parent {text(b)} ]" for a, b in zip(f.columns, f.to, strict=True))
            lines.append(f"rml:predicateObjectMap [ rml:predicate {iri(q(t.name), '#ref-', ';'.join(map(q, f.columns)))} ; rml:objectMap [ rml:parentTriplesMap <#{q(f.table)}> ; rml:joinCondition {joins} ] ]")
        out.append(" ;\n  ".join(lines) + " .\n")
    return "".join(out)
