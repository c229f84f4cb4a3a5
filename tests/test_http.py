"""Sources over HTTP from a server of this test, and the options of databases."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tripleloom.engine import Engine
from tripleloom.sources import SourceError
from tripleloom.sources.databases import declared, jdbc_options


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, dict(self.headers)))
            body = json.dumps({"people": [{"id": 1, "mail": [{"kind": "home", "at": "h"}, {"kind": "work", "at": "w"}]}, {"id": 2, "mail": []}]}).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_api_with_headers_and_parameters(spark, server, monkeypatch):
    url, seen = server
    monkeypatch.setenv("LOOM_TOKEN", "secret")
    text = f"""@prefix rml: <http://w3id.org/rml/> . @prefix ex: <http://ex.org/> . @prefix htv: <http://www.w3.org/2011/http#> .
    <#api> htv:absolutePath "{url}/people" ; htv:headers [ htv:fieldName "X-Token" ; htv:fieldValue "{{LOOM_TOKEN}}" ] ; htv:params [ htv:paramName "n" ; htv:paramValue "2" ] .
    <#A> rml:logicalSource [ rml:source <#api> ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$.people[*]" ] ; rml:subjectMap [ rml:template "http://ex.org/{{id}}" ] ;
      rml:predicateObjectMap [ rml:predicate ex:id ; rml:objectMap [ rml:reference "id" ] ] ; rml:predicateObjectMap [ rml:predicate ex:work ; rml:objectMap [ rml:reference "mail[?(@.kind=='work')].at" ] ] ."""
    got = {tuple(r) for r in Engine(spark, mapping=text).triples().collect()}
    assert got == {(f"<http://ex.org/{k}>", "<http://ex.org/id>", f'"{k}"') for k in (1, 2)} | {("<http://ex.org/1>", "<http://ex.org/work>", '"w"')}
    assert seen[-1][0] == "/people?n=2" and seen[-1][1]["X-Token"] == "secret"


def test_json_by_url(spark, server):
    url, _ = server
    text = f'@prefix rml: <http://w3id.org/rml/> . <#A> rml:logicalSource [ rml:source "{url}/people.json" ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$.people[*]" ] ; rml:subjectMap [ rml:template "http://ex.org/{{id}}" ] ; rml:predicateObjectMap [ rml:predicate <http://ex.org/at> ; rml:objectMap [ rml:reference "mail.at" ] ] .'
    assert {r.o for r in Engine(spark, mapping=text).triples().collect()} == {'"h"', '"w"'}


def test_database_urls():
    assert jdbc_options("postgresql+psycopg2://me:p%40ss@host:5432/db") == {"url": "jdbc:postgresql://host:5432/db", "user": "me", "password": "p@ss"}
    assert jdbc_options("mysql+pymysql://me@host/db?useSSL=false") == {"url": "jdbc:mysql://host/db", "useSSL": "false", "user": "me"}
    assert jdbc_options("mssql://h:1433/db")["url"] == "jdbc:sqlserver://h:1433;databaseName=db" and jdbc_options("jdbc:x:y") == {"url": "jdbc:x:y"}
    with pytest.raises(SourceError):
        jdbc_options("nosuch://h/db")


def test_declared_types():
    assert [declared(x)[1] for x in ("VARBINARY(200)", "INTEGER", "NUMERIC(5,2)", "double precision", "BOOLEAN", "DATETIME", "date", "varchar(3)", "INTERVAL")] == ["hexBinary", "integer", "decimal", "double", "boolean", "dateTime", "date", None, None]
