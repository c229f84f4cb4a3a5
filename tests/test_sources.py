"""Readers: delimited text, JSON, XML, databases, direct mapping, spreadsheets, geometry and in-memory values."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile

import pandas as pd
import pytest

from tripleloom.config import Config, Source
from tripleloom.engine import Engine
from tripleloom.mapping.direct import direct_mapping, sqlite_schema
from tripleloom.mapping.rules import LogicalSource
from tripleloom.sources import Context, SourceError, scan
from tripleloom.sources.binary import wkt
from tripleloom.sources.nested import json_path


@pytest.fixture
def rows(spark):
    def read(value, references, iterator=None, memory=None, **source):
        ctx = Context(spark, Config(sources={"": Source("", **source)}), memory or {})
        df = scan(LogicalSource("", "source", str(value), iterator), references, ctx)
        return sorted((tuple(r) for r in df.collect()), key=str)

    return read


def test_delimited_text(rows, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a ""b""\nc"\n2,\n')
    assert rows(tmp_path / "a.csv", ["id", "name"]) == [("1", 'a "b"\nc'), ("2", None)]
    (tmp_path / "b.csv").write_text("Country Code;Name\nBO;Bolivia\n")
    assert rows(tmp_path / "b.csv", ["Country Code", "Name"]) == [("BO", "Bolivia")]
    (tmp_path / "c.tsv").write_text("id\tname\n01\tx,y\n")
    assert rows(tmp_path / "c.tsv", ["id", "name", "absent"]) == [("01", "x,y", None)]
    (tmp_path / "d.csv").write_text("id,name\n")
    assert rows(tmp_path / "d.csv", ["id"]) == []


def test_empty_fields_are_text_where_they_are_no_na_value(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,\n2,x\n")
    text = f'@prefix rml: <http://w3id.org/rml/> . <#A> rml:logicalSource [ rml:source "{tmp_path}/a.csv" ] ; rml:subjectMap [ rml:template "http://ex.org/{{id}}" ] ; rml:predicateObjectMap [ rml:predicate <http://ex.org/p> ; rml:objectMap [ rml:reference "name" ] ] .'
    assert {r.o for r in Engine(spark, mapping=text).triples().collect()} == {'"x"'}
    assert {r.o for r in Engine(spark, mapping=text, na_values=("nan",)).triples().collect()} == {'"x"', '""'}


def test_json(rows, tmp_path):
    doc = {"people": [{"id": 1, "name": "a", "tags": ["x", "y"], "at": {"city": "c", "n": 1.50}}, {"id": 2, "name": None, "tags": []}, {"name": "z"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    assert rows(tmp_path / "a.json", ["id", "tags"], "$.people[*]") == [("1", "x"), ("1", "y")]
    assert ("1", "c", "1.5") in rows(tmp_path / "a.json", ["id", "at.city", "at.n"], "$.people[*]")
    assert [r for r in rows(tmp_path / "a.json", ["id", "gone"], "$.people[*]") if r[1] is not None] == []
    (tmp_path / "b.json").write_text("[" + ",".join(json.dumps({"a": k, "b": {"c": [k, k + 1]}}) for k in range(3)) + "]")
    assert len(rows(tmp_path / "b.json", ["a", "b.c"], "$[*]")) == 6
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": "two"}\n')
    assert rows(tmp_path / "c.jsonl", ["a"], "$") == [("1",), ("two",)]


def test_json_paths():
    assert json_path("$.a['b c'].*[3][*]") == ["a", "b c", "*", 3, "*"]
    for bad in ("$..a", "$.a[?(@.b)]"):
        with pytest.raises(SourceError):
            json_path(bad)


def test_xml(rows, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><cs xmlns:n="http://n"><c name="A"><rank>1</rank><b name="x"/><b name="y"/><n:k>v</n:k></c><c name="B"><rank>2</rank></c></cs>')
    assert rows(tmp_path / "a.xml", ["@name", "rank"], "/cs/c") == [("A", "1"), ("B", "2")]
    assert rows(tmp_path / "a.xml", ["@name", "b/@name"], "/cs/c") == [("A", "x"), ("A", "y")]
    assert rows(tmp_path / "a.xml", ["b@name", "b@name"][:1], "/cs/c") == [("x",), ("y",)]
    assert rows(tmp_path / "a.xml", ["n:k"], "/cs/c") == [("v",)]
    assert len(rows(tmp_path / "a.xml", ["c/@name", "c/rank"], "/*")) == 4
    assert rows(tmp_path / "a.xml", ["."], "/cs/c/rank") == [("1",), ("2",)]


def test_xml_is_read_piece_by_piece(spark, rows, tmp_path):
    """Pieces cut anywhere after a > give what the whole document does, and only the iterator's element is held."""
    import xml.etree.ElementTree as ET

    from tripleloom.sources.nested import xml_items, xml_steps, xml_stream, xml_values

    text = '<?xml version="1.0"?><!-- <c> > --><r xmlns:n="http://n" a=">"><c k="1">x<![CDATA[ > ]]><c k="2"><d>y</d></c><n:e k="3">\n</n:e></c><m><c k="4"/><d>z > z</d></m><d k="5">w</d></r>\n'
    spaces = {"n": "http://n"}
    for iterator in ("/r/c", "/r", "/*/c/c", "//c", "//d", "//c/d", "//r", "c", "d", "c/d", "m/d", "/r/c/n:e", "//n:e", "/r/*", "//*", "/x/c", "/r/m/d[1]", "/", None):
        for refs in (["@k"], ["."], ["d", "@k"]):
            want = sorted([tuple(xml_values(e, r, spaces)[:1] or [None]) if len(refs) == 1 else (e.findtext("d"), e.get("k")) for e in xml_items(ET.fromstring(text), iterator, spaces) for r in refs[:1] if len(refs) == 1 or e.find("d") is not None], key=str)
            (tmp_path / "p.xml").write_text(text)
            assert rows(tmp_path / "p.xml", refs, iterator) == want, (iterator, refs)
    held, kept = [], []

    def long():
        yield "<all>"
        for k in range(5000):
            yield f"<c k='{k}'><d/></c><other><d/></other>"
        yield "</all>"

    for e in xml_stream(long(), *xml_steps("/all/c"), {}):
        kept.append(e.get("k"))
        held.append(len(e))
    assert kept == [str(k) for k in range(5000)] and set(held) == {1}


def test_a_large_xml_document_is_split_and_bounded(spark, rows, tmp_path):
    (tmp_path / "l.xml").write_text("<all>" + "".join(f"<c k='{k}'><d>é{k}</d></c>" for k in range(60_000)) + "</all>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        assert rows(tmp_path / "l.xml", ["@k", "d"], "/all/c") == sorted(((str(k), f"é{k}") for k in range(60_000)), key=str)
        ctx = Context(spark, Config(sources={"": Source("")}), {})
        plan = scan(LogicalSource("", "source", str(tmp_path / "l.xml"), "/all/c"), ["@k"], ctx)._jdf.queryExecution().toString()
        assert "wholetext" not in plan and plan.count("MapInArrow") >= 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_memory(rows):
    own = {"d": {"k": [{"a": 1}, {"a": 2}]}, "j": '{"k": [{"a": "x"}]}', "l": [("1",), ("2",)], "p": pd.DataFrame({"a": [1, 2], "b": ['"q"', None]})}
    assert rows("{d}", ["a"], "$.k[*]", own) == [("1",), ("2",)] and rows("{j}", ["a"], "$.k[*]", own) == [("x",)]
    assert rows("{l}", ["a"], None, own) == [("1",), ("2",)] and rows("{p}", ["a", "b"], None, own) == [("1", "q"), ("2", None)]
    with pytest.raises(SourceError):
        rows("{gone}", ["a"], None, own)


@pytest.fixture
def db(tmp_path):
    path = tmp_path / "a.db"
    con = sqlite3.connect(path)
    con.executescript("""
        create table Boat (ID integer primary key, Name varchar(50));
        create table Crew (ID integer primary key, Name varchar(50), Boat integer, Weight float, Born date, Dues boolean, foreign key (Boat) references Boat (ID));
        create table "No Key" (a varchar(5), b integer);
        insert into Boat values (100, 'Heron'); insert into Crew values (10, 'Mira', 100, 71.25, '1979-03-02', 1), (20, 'Otto', null, null, null, 0); insert into "No Key" values ('x', 1), ('x', 1);
    """)
    con.close()
    return path


def test_sqlite_with_datatypes(spark, db):
    text = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://ex.org/> .
    <#S> rr:logicalTable [ rr:tableName "Crew" ] ; rr:subjectMap [ rr:template "http://ex.org/{\\"ID\\"}" ] ;
      rr:predicateObjectMap [ rr:predicate ex:id ; rr:objectMap [ rr:column "ID" ] ] ; rr:predicateObjectMap [ rr:predicate ex:w ; rr:objectMap [ rr:column "Weight" ] ] ;
      rr:predicateObjectMap [ rr:predicate ex:born ; rr:objectMap [ rr:column "Born" ] ] ; rr:predicateObjectMap [ rr:predicate ex:dues ; rr:objectMap [ rr:column "Dues" ] ] .
    <#Q> rr:logicalTable [ rr:sqlQuery "select s.ID as i, p.Name as n from Crew s join Boat p on s.Boat = p.ID" ] ; rr:subjectMap [ rr:template "http://ex.org/{i}" ] ; rr:predicateObjectMap [ rr:predicate ex:sails ; rr:objectMap [ rr:column "n" ] ] ."""
    got = {(r.p.rsplit("/", 1)[1][:-1], r.o) for r in Engine(spark, mapping=text, db_url=f"sqlite:///{db}", infer_sql_datatypes=True).triples().collect()}
    x = "^^<http://www.w3.org/2001/XMLSchema#"
    assert got == {("id", f'"10"{x}integer>'), ("id", f'"20"{x}integer>'), ("w", f'"71.25"{x}double>'), ("born", f'"1979-03-02"{x}date>'), ("dues", f'"true"{x}boolean>'), ("dues", f'"false"{x}boolean>'), ("sails", '"Heron"')}


def test_sqlite_is_read_by_tasks(spark, tmp_path, monkeypatch):
    """No row passes the driver; ranges of row numbers (negative, far apart) and queries give every row once, in their types."""
    from tripleloom.sources import databases

    con = sqlite3.connect(tmp_path / "b.db")
    con.execute("create table n (k integer, x double, b boolean, rowid text, bytes blob)")
    data = [(k if k % 7 else None, k / 2 if k % 3 else k, k % 2, "r" * 99, b"\x01" if k % 2 else "t") for k in range(2**60, 2**60 + 3000)]
    con.executemany("insert into n (_rowid_, k, x, b, rowid, bytes) values (?, ?, ?, ?, ?, ?)", ((j - 9 if j < 2900 else 2**62 + j, *r) for j, r in enumerate(data)))
    con.execute("create table w (a text primary key, b) without rowid")
    con.executemany("insert into w values (?, ?)", [("x", 1), ("y", 2.5), ("z", None)])
    con.execute("create table e (a integer)")
    con.commit()
    con.close()
    monkeypatch.setattr(databases, "PIECE", 20_000)
    ctx = Context(spark, Config(sources={"": Source("", db_url=f"sqlite:///{tmp_path}/b.db")}))
    df = databases.database(ctx, LogicalSource("", "tableName", "n"))
    assert "MapInArrow" in df._jdf.queryExecution().toString() and df.rdd.getNumPartitions() > 10
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((k, float(x), bool(b), r, y if isinstance(y, bytes) else y.encode()) for k, x, b, r, y in data), key=key)
    assert sorted(((k, x, b, r, bytes(y)) for k, x, b, r, y in df.collect()), key=key) == want
    df = databases.database(ctx, LogicalSource("", "query", "with q as (select k from n) select k, k as K2, 'a' || k as t from q where k is not null -- end"))
    assert "MapInArrow" in df._jdf.queryExecution().toString() and df.dtypes == [("k", "bigint"), ("K2", "bigint"), ("t", "string")]
    assert sorted(r.k for r in df.collect()) == sorted(r[0] for r in data if r[0])
    df = databases.database(ctx, LogicalSource("", "tableName", "w"))
    assert sorted(map(tuple, df.collect())) == [("x", "1"), ("y", "2.5"), ("z", None)]
    assert databases.database(ctx, LogicalSource("", "tableName", "e")).collect() == []


def test_direct_mapping_of_a_database(spark, db):
    text = direct_mapping(sqlite_schema(str(db)), "http://ex.org/")
    got = {(r.s, r.p, r.o) for r in Engine(spark, mapping=text, db_url=f"sqlite:///{db}").triples().collect()}
    assert ("<http://ex.org/Crew/ID=10>", "<http://ex.org/Crew#ref-Boat>", "<http://ex.org/Boat/ID=100>") in got
    assert ("<http://ex.org/Crew/ID=20>", "<http://ex.org/Crew#Name>", '"Otto"') in got
    assert not any(s.endswith("ID=20>") and "Weight" in p for s, p, _ in got)
    blank = {s for s, _, _ in got if s.startswith("_:")}
    assert len(blank) == 2 and all((s, "<http://ex.org/No%20Key#a>", '"x"') in got for s in blank)


def test_spreadsheet(rows, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>id</t></si><si><t>name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    assert rows(tmp_path / "a.xlsx", ["id", "name"]) == [("7", "Ann")]


def test_stata_feather_and_parquet(rows, tmp_path):
    df = pd.DataFrame({"id": [1, 2], "name": ["a", "b"]})
    df.to_stata(tmp_path / "a.dta", write_index=False)
    df.to_feather(tmp_path / "a.feather")
    df.to_parquet(tmp_path / "a.parquet")
    for name in ("a.dta", "a.feather", "a.parquet"):
        assert rows(tmp_path / name, ["id", "name"]) == [("1", "a"), ("2", "b")], name


def test_geometry(rows, tmp_path):
    point = struct.pack("<BIdd", 1, 1, 1.5, -2.0)
    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    assert wkt(point) == "POINT (1.5 -2)" and wkt(line) == "LINESTRING (0 0, 1 1)" and wkt(None) is None
    pd.DataFrame({"id": ["1"], "geometry": [point]}).to_parquet(tmp_path / "a.geoparquet")
    assert rows(tmp_path / "a.geoparquet", ["id", "geometry"]) == [("1", "POINT (1.5 -2)")]


def test_shapefile(rows, tmp_path):
    shp = io.BytesIO()
    content = struct.pack("<idd", 1, 3.0, 4.0)
    shp.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + 8 + len(content)) // 2) + struct.pack("<2i8d", 1000, 1, *([0.0] * 8)))
    shp.write(struct.pack(">2i", 1, len(content) // 2) + content)
    (tmp_path / "a.shp").write_bytes(shp.getvalue())
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(bytes([3, 24, 1, 1]) + struct.pack("<IHH", 1, 32 + 32 + 1, 6) + b"\0" * 20 + field + b"\r" + b" " + b"Ann  " + b"\x1a")
    assert rows(tmp_path / "a.shp", ["name", "geometry"]) == [("Ann", "POINT (3 4)")]


def test_unknown_formats_are_refused(rows, tmp_path):
    with pytest.raises(SourceError):
        rows(tmp_path / "a.bin", ["x"])


@pytest.mark.parametrize("url", ["neo4j://host:7687@user:pa%40ss/db", "neo4j://user:pa%40ss@host:7687/db", "neo4j://user:pa%40ss@host/db"])
def test_cypher_urls(url):
    from tripleloom.sources.databases import cypher_options

    assert cypher_options(url) == {"url": "neo4j://host:7687", "authentication.basic.username": "user", "authentication.basic.password": "pa@ss", "database": "db"}
    assert cypher_options("bolt://host:7999") == {"url": "bolt://host:7999"}
    with pytest.raises(SourceError):
        cypher_options("no url")


def test_view_dialect():
    from tripleloom.sources.views import expand, translate

    assert expand(translate("select unnest(str_split(a, ',(')) from t")) == "select explode(split(a, concat('\\\\Q', ',(', '\\\\E'), -1)) from t"
    assert translate("select strftime(d, '%d %B, week') from t").startswith("select date_format(d, 'dd MMMM, \\'week\\'')")
    with pytest.raises(SourceError):
        translate("select strftime(d, '%U') from t")
