"""Relational databases over JDBC, SQLite files by the standard library in tasks, and graph databases by their Spark connector."""

from __future__ import annotations

import os
import re
import sqlite3
from urllib.parse import parse_qs, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

from ..mapping.rules import LogicalSource
from ..vocab import XSD
from . import Context, SourceError

JDBC = {"mysql": "mysql", "mariadb": "mariadb", "postgresql": "postgresql", "postgres": "postgresql", "oracle": "oracle:thin", "mssql": "sqlserver", "sqlserver": "sqlserver", "snowflake": "snowflake", "databricks": "databricks"}
#: Declared column types by a part of their name, first match: Spark type, XSD type.
TYPES = [
    ("VARBINARY", "binary", "hexBinary"), ("BINARY", "binary", "hexBinary"), ("BLOB", "binary", "hexBinary"), ("BYTEA", "binary", "hexBinary"), ("INTERVAL", "string", None), ("POINT", "string", None), ("BOOL", "boolean", "boolean"), ("TINYINT", "boolean", "boolean"),
    ("INT", "long", "integer"), ("SERIAL", "long", "integer"), ("DEC", "string", "decimal"), ("NUMERIC", "string", "decimal"), ("FLOAT", "double", "double"), ("REAL", "double", "double"), ("DOUB", "double", "double"), ("NUMBER", "double", "double"), ("MONEY", "string", "decimal"),
    ("DATETIME", "string", "dateTime"), ("TIMESTAMP", "string", "dateTime"), ("DATE", "string", "date"), ("TIME", "string", "time"),
]


def declared(name: str) -> tuple[str, str | None]:
    up = name.upper()
    return next(((s, x) for k, s, x in TYPES if k in up), ("string", None))


SPARK_XSD = {"byte": "integer", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "double", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "binary": "hexBinary"}


def xsd_of(spark_type: str) -> str | None:
    name = "decimal" if spark_type.startswith("decimal") else SPARK_XSD.get(spark_type)
    return XSD + name if name else None


#: Bytes of a SQLite file that one task reads.
PIECE = 16_000_000
FETCH = 10_000


def _made(kind: str, v):
    """A SQLite value as one of a column's Spark type."""
    if v is None:
        return None
    match kind:
        case "long":
            return v if isinstance(v, int) else None if isinstance(v, bytes) else int(float(v))
        case "double":
            return float(v)
        case "boolean":
            return str(v).lower() in ("1", "true", "t", "yes")
        case "binary":
            return v if isinstance(v, bytes) else str(v).encode()
    return str(v)


def _column(kind: str, values: tuple, arrow: pa.DataType) -> pa.Array:
    """A column of SQLite values; where all are of its type already, none is looked at by itself."""
    try:
        return pa.array(values, arrow)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        return pa.array([_made(kind, v) for v in values], arrow)


def _reachable(ctx: Context, path: str) -> str | None:
    """The path, if executors see the file there; else None, and the file is sent to each of them."""
    sc = ctx.spark.sparkContext
    if sc.master.startswith("local"):
        return path
    size, n = os.path.getsize(path), sc.defaultParallelism
    if all(sc.parallelize(range(n), n).map(lambda _: os.path.exists(path) and os.path.getsize(path) == size).collect()):
        return path
    sc.addFile(path)
    return None


def _seen(db: sqlite3.Connection, query: str, n: int) -> list[str]:
    """Spark types of a query's columns, by all its values; no row is kept."""
    cs = [f"c{k}" for k in range(n)]
    try:
        found = db.execute(f"WITH loom ({', '.join(cs)}) AS ({query}\n) SELECT DISTINCT {', '.join(f'typeof({c})' for c in cs)} FROM loom")
        kinds = [set(x) - {"null"} for x in zip(*found)] or [set()] * n
    except sqlite3.OperationalError:  # no query that can stand within another
        names = {int: "integer", float: "real", bytes: "blob", str: "text"}
        kinds = [set() for _ in cs]
        for r in db.execute(query):
            for own, v in zip(kinds, r):
                if v is not None:
                    own.add(names[type(v)])
    return ["long" if own == {"integer"} else "double" if own and own <= {"integer", "real"} else "binary" if own == {"blob"} else "string" for own in kinds]


def _row_ids(db: sqlite3.Connection, table: str, names: list[str]) -> tuple[str, int, int] | None:
    """The name of a table's row number, its least and greatest; None for views, tables without one and empty ones."""
    taken = {n.lower() for n in names}
    for name in (x for x in ("rowid", "_rowid_", "oid") if x not in taken):
        try:
            lo, hi = db.execute(f'SELECT (SELECT min({name}) FROM "{table}"), (SELECT max({name}) FROM "{table}")').fetchone()
        except sqlite3.OperationalError:
            return None
        return (name, lo, hi) if isinstance(lo, int) and isinstance(hi, int) else None
    return None


def _sqlite(ctx: Context, path: str, source: LogicalSource) -> DataFrame:
    """Tasks read the file, batch by batch: a table by ranges of its row numbers, a query in one task. The driver looks at types and ranges only."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        pieces = -(-os.path.getsize(path) // PIECE)
        if source.kind == "tableName":
            table = source.value.replace('"', '""')
            info = db.execute(f'PRAGMA table_info("{table}")').fetchall()
            if not info:
                raise SourceError(f"no table {source.value!r} in {path}")
            kinds = {r[1]: declared(r[2])[0] for r in info}
            query = f'SELECT * FROM "{table}"'
            names = [d[0] for d in db.execute(query + " LIMIT 0").description]
            own = [kinds[n] for n in names]
            ids = _row_ids(db, table, names)
        else:
            query, ids = source.value.strip().rstrip(";"), None
            names = [d[0] for d in db.execute(query).description]
            own = _seen(db, query, len(names))
    finally:
        db.close()
    if ids:
        number, lo, hi = ids
        n = max(1, min(pieces, hi - lo + 1))
        cuts = [lo + (hi + 1 - lo) * k // n for k in range(n + 1)]
        queries = [f"{query} WHERE {number} >= {a} AND {number} < {b}" for a, b in zip(cuts, cuts[1:-1])] + [f"{query} WHERE {number} >= {cuts[-2]}"]
    else:
        queries = [query]
    at, file = _reachable(ctx, path), os.path.basename(path)
    arrow = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[t] for t in own]

    def read(batches):
        from pyspark import SparkFiles

        for batch in batches:
            for k in batch.column(0).to_pylist():
                db = sqlite3.connect(f"file:{at or SparkFiles.get(file)}?mode=ro", uri=True)
                try:
                    cursor = db.execute(queries[k])
                    while rows := cursor.fetchmany(FETCH):
                        yield pa.RecordBatch.from_arrays([_column(t, c, a) for t, a, c in zip(own, arrow, zip(*rows))], [f"c{j}" for j in range(len(own))])
                finally:
                    db.close()

    out = ctx.spark.range(0, len(queries), 1, len(queries)).mapInArrow(read, ", ".join(f"c{k} {t}" for k, t in enumerate(own)))
    if len(queries) == 1 and pieces > 1:  # what follows shall not be one task's work; up to 200 parts are written without sorting
        out = out.repartition(min(pieces, 200), *out.columns)
    return out.toDF(*names)


def table_types(ctx: Context, source: LogicalSource) -> dict[str, str | None]:
    """XSD types of a table's columns."""
    section = ctx.config.sources.get(source.section)
    if section and section.db_url.startswith("sqlite") and source.kind == "tableName":
        path = re.sub(r"^sqlite:/{0,3}(?=[^/])|^sqlite:///(?=/)", "", section.db_url)
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            name = source.value.replace('"', '""')
            return {r[1]: (XSD + x if (x := declared(r[2])[1]) else None) for r in db.execute(f'PRAGMA table_info("{name}")')}
        finally:
            db.close()
    from . import schema_of

    schema = schema_of(source, ctx)
    return {f.name: xsd_of(f.dataType.simpleString()) for f in schema.fields} if schema else {}


def jdbc_options(url: str) -> dict[str, str]:
    """JDBC options of a database URL like dialect+driver://user:password@host:port/name?options."""
    if url.startswith("jdbc:"):
        return {"url": url}
    u = urlparse(url)
    dialect = u.scheme.split("+")[0]
    if dialect not in JDBC:
        raise SourceError(f"unknown database {dialect!r}")
    host = u.hostname + (f":{u.port}" if u.port else "")
    name, extra = u.path.lstrip("/"), {k: v[0] for k, v in parse_qs(u.query).items()}
    where = {"oracle": f"@//{host}/{extra.pop('service_name', name)}", "mssql": f"//{host};databaseName={name}", "sqlserver": f"//{host};databaseName={name}"}.get(dialect, f"//{host}/{name}")
    out = {"url": f"jdbc:{JDBC[dialect]}:{where}"} | extra
    if u.username:
        out["user"] = unquote(u.username)
    if u.password:
        out["password"] = unquote(u.password)
    return out


def database(ctx: Context, source: LogicalSource) -> DataFrame:
    """A table or query. Spark pushes projections and filters down; partitionColumn, lowerBound, upperBound and numPartitions of the section split a table's scan."""
    section = ctx.config.sources[source.section]
    if section.db_url.startswith("sqlite"):
        return _sqlite(ctx, re.sub(r"^sqlite:/{0,3}(?=[^/])|^sqlite:///(?=/)", "", section.db_url), source)
    reader = ctx.spark.read.format("jdbc").options(**jdbc_options(section.db_url), **{k: str(v) for k, v in (section.connect_args | section.options).items()})
    return (reader.option("dbtable", source.value) if source.kind == "tableName" else reader.option("query", source.value)).load()


def cypher(ctx: Context, source: LogicalSource) -> DataFrame:
    """A Cypher query, by the database's Spark connector, which has to be on the class path."""
    section = ctx.config.sources[source.section]
    return ctx.spark.read.format(section.options.get("connector", "org.neo4j.spark.DataSource")).options(**cypher_options(section.db_url)).option("query", source.value).load()


def cypher_options(url: str) -> dict[str, str]:
    """Options of the connector from scheme://host:port@user:password/database or scheme://user:password@host:port/database; port, user and database may be missing."""
    found = re.fullmatch(r"([\w+]+)://(?:(.*)@)?([^@]*?)(?:/([^/@]*))?", url)
    if not found:
        raise SourceError(f"not a database URL: {url!r}")
    scheme, before, after, name = found.groups()
    host_first = before is not None and re.fullmatch(r"[\w.-]+:\d+", before) and ":" in after and not re.fullmatch(r"[\w.-]+:7\d{3}", after)
    # A password may hold an @ only where it is written as %40.
    host, login = (before, after) if host_first else (after, before)
    out = {"url": f"{scheme}://{host if ':' in host else host + ':7687'}"}
    if login:
        user, _, password = login.partition(":")
        out |= {"authentication.basic.username": unquote(user), "authentication.basic.password": unquote(password)}
    return out | ({"database": name} if name else {})
