"""Term rules, normalization, joins, quoting, partitioning, configuration and sinks, on small tables written by hand."""

from __future__ import annotations

import random
import re

import pytest

from tripleloom.config import ConfigError, load_config
from tripleloom.engine import Engine, materialize, materialize_set, translate_to_rml
from tripleloom.mapping.normalize import MappingError
from tripleloom.plans.partition import partition
from tripleloom.rdf import RDFError, isomorphic, parse_nquads, parse_turtle
from tripleloom.sinks import kafka_rows, write, write_folder, write_groups

HEAD = """@prefix rml: <http://w3id.org/rml/> . @prefix ex: <http://ex.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix grel: <http://users.ugent.be/~bjdmeest/function/grel.ttl#> .
"""
PEOPLE = [("1", "Ann", "2"), ("2", 'B "q"\n\\', None), ("3", "", "2"), ("4", "nan", "9"), ("5", "Ärger & co", "1")]
BOATS = [("1", "chess"), ("2", "go"), ("2", "judo")]


@pytest.fixture(scope="module")
def memory(spark):
    return {"people": spark.createDataFrame(PEOPLE, "ID string, Name string, Boat string"), "boats": spark.createDataFrame(BOATS, "ID string, Name string")}


def run(spark, text, memory, **options):
    return {tuple(r) for r in Engine(spark, mapping=HEAD + text, memory=memory, **options).quads().collect()}


def tm(name, source, subject, *poms):
    return f'<#{name}> rml:logicalSource [ rml:source "{{{source}}}" ] ; rml:subjectMap [ {subject} ]' + "".join(f" ; rml:predicateObjectMap [ rml:predicate ex:{p} ; rml:objectMap [ {o} ] ]" for p, o in poms) + " .\n"


def test_null_and_na_values_drop_the_row_of_the_rule(spark, memory):
    text = tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("name", 'rml:reference "Name"'), ("boat", 'rml:reference "Boat"'))
    got = run(spark, text, memory)
    assert {(s, o) for s, p, o, _ in got if p == "<http://ex.org/name>"} == {("<http://ex.org/1>", '"Ann"'), ("<http://ex.org/2>", '"B \\"q\\"\\n\\\\"'), ("<http://ex.org/5>", '"Ärger & co"')}
    assert {s for s, p, _, _ in got if p == "<http://ex.org/boat>"} == {f"<http://ex.org/{k}>" for k in (1, 3, 4, 5)}


def test_iri_templates_are_encoded_and_references_are_not(spark, memory):
    got = run(spark, tm("A", "people", 'rml:template "http://ex.org/{Name}"', ("is", 'rml:reference "Name" ; rml:termType rml:IRI')), memory)
    assert ("<http://ex.org/%C3%84rger%20%26%20co>", "<http://ex.org/is>", "<Ärger & co>", None) in got


def test_escaped_braces(spark, memory):
    got = run(spark, tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("x", 'rml:template "\\\\{{ID}\\\\}" ; rml:termType rml:Literal')), memory)
    assert ("<http://ex.org/1>", "<http://ex.org/x>", '"{1}"', None) in got


def test_join_keeps_set_semantics(spark, memory):
    text = tm("S", "boats", 'rml:template "http://ex.org/boat/{ID}"') + tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("sails", 'rml:parentTriplesMap <#S> ; rml:joinCondition [ rml:child "Boat" ; rml:parent "ID" ]'))
    df = Engine(spark, mapping=HEAD + text, memory=memory).quads()
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) == 3
    assert {(s[-2], o[-2]) for s, _, o, _ in rows} == {("1", "2"), ("3", "2"), ("5", "1")}


def test_a_join_without_condition_between_sources_is_refused(spark, memory):
    text = tm("S", "boats", 'rml:template "http://ex.org/boat/{ID}"') + tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("sails", "rml:parentTriplesMap <#S>"))
    with pytest.raises(ValueError):
        run(spark, text, memory)


def test_self_join_elimination_can_be_switched_off(spark, memory):
    text = tm("S", "boats", 'rml:template "http://ex.org/n/{Name}"') + tm("A", "boats", 'rml:template "http://ex.org/{ID}"', ("is", 'rml:parentTriplesMap <#S> ; rml:joinCondition [ rml:child "ID" ; rml:parent "ID" ]'))
    assert len(run(spark, text, memory)) == 3
    plan = Engine(spark, mapping=HEAD + text, memory=memory).quads()._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert run(spark, text, memory, self_join_elimination=False) == run(spark, text, memory)


def test_quoted_statements_nest_and_join(spark, memory):
    text = tm("N", "boats", 'rml:template "http://ex.org/boat/{ID}"', ("name", 'rml:reference "Name"')).replace("<#N>", "<#N> a rml:NonAssertedTriplesMap ;", 1)
    text += tm("Q", "people", 'rml:template "http://ex.org/{ID}"', ("knows", 'rml:quotedTriplesMap <#N> ; rml:joinCondition [ rml:child "Boat" ; rml:parent "ID" ]'))
    got = run(spark, text, memory)
    assert {o for s, _, o, _ in got if s == "<http://ex.org/1>"} == {f'<< <http://ex.org/boat/2> <http://ex.org/name> "{n}" >>' for n in ("go", "judo")}
    assert all(p == "<http://ex.org/knows>" for _, p, _, _ in got)


def test_graphs_and_output_formats(spark, memory, tmp_path):
    text = tm("A", "boats", 'rml:template "http://ex.org/{ID}" ; rml:graph ex:g', ("name", 'rml:reference "Name"'))
    assert {g for *_, g in run(spark, text, memory)} == {"<http://ex.org/g>"}
    e = Engine(spark, mapping=HEAD + text, memory=memory, output_file=str(tmp_path / "out"), output_format="N-QUADS")
    write(e)
    lines = (tmp_path / "out.nq").read_text().splitlines()
    assert len(lines) == 3 and parse_nquads("\n".join(lines)) == {tuple(x for x in q if x) for q in run(spark, text, memory)}
    e = Engine(spark, mapping=HEAD + text, memory=memory)
    write_folder(e, str(tmp_path / "folder"))
    assert sum(p.read_text().count(" .\n") for p in (tmp_path / "folder").glob("part-*")) == 3
    assert {r.key for r in kafka_rows(e).collect()} == {"<http://ex.org/1>", "<http://ex.org/2>"}
    with pytest.raises(ValueError, match="kafka"):
        from tripleloom.sinks import write_kafka

        write_kafka(e)


def test_groups_are_written_apart_and_disjoint(spark, memory, tmp_path):
    text = tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("name", 'rml:reference "Name"'), ("boat", 'rml:reference "Boat"'), ("like", 'rml:template "http://ex.org/s/{Boat}"'))
    e = Engine(spark, mapping=HEAD + text, memory=memory)
    paths = write_groups(e, str(tmp_path / "groups"))
    assert len(paths) == len(e.groups) == 3
    lines = [line for p in paths for f in sorted((tmp_path / "groups" / p.rsplit("/", 1)[1]).glob("part-*")) for line in f.read_text().splitlines()]
    assert len(lines) == len(set(lines)) == len(run(spark, text, memory))


def random_mapping(rng):
    maps = []
    for k in range(rng.randint(1, 4)):
        subject = rng.choice(['rml:template "http://ex.org/{ID}"', 'rml:template "http://ex.org/a/{ID}"', 'rml:template "b{ID}" ; rml:termType rml:BlankNode', 'rml:reference "Name" ; rml:termType rml:IRI', "rml:constant ex:all"])
        objects = ['rml:reference "Name"', 'rml:reference "Name" ; rml:language "en"', 'rml:template "http://ex.org/{Name}"', 'rml:constant "x"', 'rml:reference "ID" ; rml:datatype xsd:integer', 'rml:template "http://ex.org/a/{ID}"', 'rml:template "{ID}{Name}" ; rml:termType rml:Literal']
        maps.append(tm(f"M{k}", rng.choice(["people", "boats"]), subject, *((rng.choice("pq"), rng.choice(objects)) for _ in range(rng.randint(1, 3)))))
    return "".join(maps)


@pytest.mark.parametrize("seed", range(6))
def test_partitioning_changes_nothing(spark, memory, seed):
    text = random_mapping(random.Random(seed))
    results = []
    for policy in ("NO", "PARTIAL-AGGREGATIONS", "MAXIMAL"):
        rows = [tuple(r) for r in Engine(spark, mapping=HEAD + text, memory=memory, mapping_partitioning=policy).quads().collect()]
        assert len(rows) == len(set(rows)), policy
        results.append(set(rows))
    assert results[0] == results[1] == results[2]


def test_rules_of_a_group_that_share_no_statement_shuffle_columns(spark, sf):
    """Also beside rules that share statements; null values and all policies included."""
    subject = 'rml:subjectMap [ rml:template "http://ex.org/{c_custkey}" ]'
    poms = "".join(f" ; rml:predicateObjectMap [ rml:predicate ex:{p} ; rml:objectMap [ {o} ] ]" for p, o in (("a", 'rml:reference "c_name"'), ("b", 'rml:template "http://ex.org/n/{c_nationkey}"'), ("c", 'rml:template "x{c_name}" ; rml:termType rml:Literal'), ("c", 'rml:reference "c_mktsegment"')))
    text = HEAD + f'<#A> rml:logicalSource [ rml:source "{sf}/customer.parquet" ] ; {subject}{poms} .'
    df = Engine(spark, mapping=text, mapping_partitioning="NO").quads()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and re.search(r"Exchange hashpartitioning\([^)]*\bk#", plan)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in Engine(spark, mapping=text).quads().collect()} == {tuple(r) for r in Engine(spark, mapping=text, mapping_partitioning="MAXIMAL").quads().collect()}


def test_rows_are_spread_before_a_function_makes_lists_of_them(spark, sf, monkeypatch):
    from tripleloom.plans import compile as plans

    monkeypatch.setattr(plans, "SMALL", 10)
    call = 'rml:functionExecution [ rml:function grel:unicodestring-s ; rml:input [ rml:parameter grel:valueParameter ; rml:inputValueMap [ rml:reference "p_brand" ] ] ]'
    text = HEAD + f'<#A> rml:logicalSource [ rml:source "{sf}/part.parquet" ] ; rml:subjectMap [ rml:template "http://ex.org/{{p_partkey}}" ] ; rml:predicateObjectMap [ rml:predicate ex:c ; rml:objectMap [ {call} ] ] .'
    df = Engine(spark, mapping=text).quads()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan.split("Generate explode")[1]
    got = [tuple(r) for r in df.collect()]
    monkeypatch.undo()
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in Engine(spark, mapping=text).quads().collect()}


def test_shuffled_parts_are_small_unless_their_size_is_set(spark, memory):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        for given, want in ((None, "16MB"), ("100MB", "100MB")):
            spark.conf.set(name, given) if given else spark.conf.unset(name)
            Engine(spark, mapping=HEAD + tm("A", "boats", 'rml:template "http://ex.org/{ID}"', ("name", 'rml:reference "Name"')), memory=memory)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_maximal_partitioning_has_at_least_as_many_groups(spark, memory):
    for seed in range(20):
        rules = [r for r in Engine(spark, mapping=HEAD + random_mapping(random.Random(seed)), memory=memory).rules if r.predicate]
        assert 1 == len(partition(rules, "NO")) <= len(partition(rules)) <= len(partition(rules, "MAXIMAL")) <= len(rules)


def test_a_scan_is_shared_and_narrow(spark, sf):
    poms = "".join(f' ; rml:predicateObjectMap [ rml:predicate ex:p{k} ; rml:objectMap [ rml:reference "{c}" ] ]' for k, c in enumerate(("c_name", "c_mktsegment")))
    text = HEAD + f'<#A> rml:logicalSource [ rml:source "{sf}/customer.parquet" ] ; rml:subjectMap [ rml:template "http://ex.org/{{c_custkey}}" ]{poms} .'
    plan = Engine(spark, mapping=text, mapping_partitioning="NO").quads()._jdf.queryExecution().toString()
    assert plan.count("FileScan parquet") == 1 and "c_acctbal" not in plan.split("ReadSchema")[1]
    unique = Engine(spark, mapping=text, keys={f"{sf}/customer.parquet": {"c_custkey"}}).quads()._jdf.queryExecution().toString()
    assert "Exchange" not in unique


def test_no_row_twice_where_safe_characters_part_references(spark):
    df = spark.createDataFrame([("x/y", "z"), ("x", "y/z")], "a string, b string")
    text = tm("A", "t", 'rml:template "http://ex.org/{a}/{b}"', ("is", 'rml:constant "v"'))
    for safe, n in (("", 2), ("/", 1)):
        assert Engine(spark, mapping=HEAD + text, memory={"t": df}, safe_percent_encoding=safe).quads().count() == n


def test_joined_rows_lose_duplicates_before_terms(spark, memory):
    text = tm("S", "boats", 'rml:template "http://ex.org/boat/{Name}"') + tm("A", "people", 'rml:template "http://ex.org/{Boat}"', ("sails", 'rml:parentTriplesMap <#S> ; rml:joinCondition [ rml:child "Boat" ; rml:parent "ID" ]'))
    df = Engine(spark, mapping=HEAD + text, memory=memory).quads()
    rows = [tuple(r)[:3] for r in df.collect()]
    assert sorted(rows) == [(f"<http://ex.org/{k}>", "<http://ex.org/sails>", f"<http://ex.org/boat/{n}>") for k, n in (("1", "chess"), ("2", "go"), ("2", "judo"))]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate [Boat#") and "__parent_Name" in plan.split("]")[0]


def test_mapping_errors(spark, memory):
    with pytest.raises((MappingError, ValueError)):
        run(spark, tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("p", 'rml:reference "ID"')).replace("rml:predicate ex:p", 'rml:predicateMap [ rml:template "b{ID}" ; rml:termType rml:BlankNode ]'), memory)
    with pytest.raises((MappingError, ValueError)):
        run(spark, tm("A", "people", 'rml:reference "ID" ; rml:termType rml:Literal', ("p", 'rml:reference "ID"')), memory)
    with pytest.raises(ValueError, match="no-such"):
        run(spark, tm("A", "no-such", 'rml:template "http://ex.org/{ID}"', ("p", 'rml:reference "ID"')), memory)


def test_turtle():
    text = """@prefix a: <http://a/> . @base <http://b/> . # note
    a:s a a:C ; a:p "x\\ty"@en-GB , \"""long "quoted"
    text\""" , 3 , 1.5 , true , <rel> ; a:q [ a:r ( 1 2 ) ] . _:n a:p _:n ."""
    triples = parse_turtle(text)
    assert len(triples) == 14 and any(str(o) == "http://b/rel" for _, _, o in triples)
    for bad in ("a:s a:p a:o .", "<s> <p> .", "<s> <p> 'x", "@prefix a: ."):
        with pytest.raises((RDFError, ValueError)):
            parse_turtle(bad)


def test_isomorphism():
    a = parse_nquads('_:x <p> _:y .\n_:y <p> "1" .')
    assert isomorphic(a, parse_nquads('_:b <p> _:a .\n_:a <p> "1" .'))
    assert not isomorphic(a, parse_nquads('_:b <p> _:a .\n_:b <p> "1" .'))


def test_configuration_file(spark, tmp_path, memory):
    (tmp_path / "people.csv").write_text('ID,Name\n1,"Ann, B."\n2,\n')
    (tmp_path / "m.ttl").write_text(HEAD + f'<#A> rml:logicalSource [ rml:source "{tmp_path}/people.csv" ] ; rml:subjectMap [ rml:template "http://ex.org/{{ID}}" ] ; rml:predicateObjectMap [ rml:predicate ex:name ; rml:objectMap [ rml:reference "Name" ] ] .')
    ini = f"[CONFIGURATION]\noutput_file = {tmp_path}/kg\nna_values = ,nan,None\n[one]\nmappings = {tmp_path}/m.ttl\n"
    (tmp_path / "c.ini").write_text(ini)
    assert materialize_set(spark, ini) == {'<http://ex.org/1> <http://ex.org/name> "Ann, B."'}
    assert materialize(spark, str(tmp_path / "c.ini")).count() == 1
    write(Engine(spark, ini))
    assert (tmp_path / "kg.nt").read_text() == '<http://ex.org/1> <http://ex.org/name> "Ann, B." .\n'
    c = load_config(ini)
    assert c.na_values == ("", "nan", "None") and c.output_path.endswith(".nt")
    for bad in ("[CONFIGURATION]\noutput_format = XML\n[a]\nmappings = x\n", "[CONFIGURATION]\nmapping_partitioning = SOME\n[a]\nmappings = x\n", "[CONFIGURATION]\n", "[a]\nfile_path = x\n", "[CONFIGURATION]\nlogging_level = LOUD\n[a]\nmappings = x\n"):
        with pytest.raises(ConfigError):
            load_config(bad)


def test_translation_of_older_vocabularies():
    text = translate_to_rml('@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://ex.org/> .\n<#A> rr:logicalTable [ rr:tableName "t" ] ; rr:subjectMap [ rr:template "http://ex.org/{id}" ; rr:class ex:C ] ; rr:predicateObjectMap [ rr:predicate ex:p ; rr:objectMap [ rr:column "c" ] ] .')
    assert "r2rml" not in text and "<http://w3id.org/rml/reference>" in text and "<http://w3id.org/rml/tableName>" in text


def test_user_functions(spark, memory, tmp_path):
    (tmp_path / "udfs.py").write_text("""
@udf(fun_id="http://ex.org/initials", text="http://ex.org/text")
def initials(text):
    return [w[0] for w in text.split()] if text != "Ann" else None
""")
    text = tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("i", 'rml:functionExecution [ rml:function ex:initials ; rml:input [ rml:parameter ex:text ; rml:inputValueMap [ rml:reference "Name" ] ] ]'))
    got = run(spark, text, memory, udfs=str(tmp_path / "udfs.py"))
    assert {o for s, _, o, _ in got if s == "<http://ex.org/5>"} == {'"Ä"', '"&"', '"c"'} and not any(s == "<http://ex.org/1>" for s, *_ in got)


def test_compatible_results_of_odd_functions(spark, memory):
    def call(function, *args):
        own = " , ".join(f'[ rml:parameter {p} ; rml:inputValueMap [ rml:constant "{v}" ] ]' for p, v in args)
        return tm("A", "boats", 'rml:template "http://ex.org/{ID}"', ("x", f"rml:functionExecution [ rml:function {function} ; rml:input {own} ]"))

    def value(text, **options):
        (o,) = {o for _, _, o, _ in run(spark, text, memory, **options)}
        return o.strip('"')

    diff = lambda unit: call("grel:date_diff", ("grel:p_datetime_d", "2024-01-01T00:00:00"), ("grel:p_datetime_d2", "2024-01-03T01:00:05"), ("grel:p_string_timeunit", unit))
    assert [value(diff(u)) for u in "dhms"] == ["2", "49", "2940", "176405"]
    assert [value(diff(u), compat=True) for u in "dhms"] == ["2", "216300", "2940", "3605"]
    url = call("<http://example.com/idlab/function/toUpperCaseURL>", ("<http://example.com/idlab/function/str>", "https://a.org/b"))
    assert value(url) == "https://A.ORG/B" and value(url, compat=True) == "https://HTTPS%3A%2F%2F"


def test_streams(spark, tmp_path):
    from tripleloom.streaming import stream_quads

    spark.createDataFrame([("1", "Ann"), ("1", "Ann"), ("2", None)], "ID string, Name string").selectExpr("*", "timestamp '2024-01-01 00:00:00' as ts").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ID string, Name string, ts timestamp").parquet(f"file://{tmp_path}/in")
    text = HEAD + tm("A", "people", 'rml:template "http://ex.org/{ID}"', ("name", 'rml:reference "Name"'))
    out = stream_quads(spark, text, {"people": stream}, "ts")
    assert out.isStreaming
    q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.read.parquet(f"file://{tmp_path}/out").select("s", "p", "o").collect()] == [("<http://ex.org/1>", "<http://ex.org/name>", '"Ann"')]
