"""Queries over the shared tables, each with the SQL that gives its rows.

A query is a mapping; its result is its statements (s, p, o) or, where graphs matter, (s, p, o, g).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .engine import Engine
from .mapping.direct import ForeignKey, catalog_schema, direct_mapping
from .vocab import GREL, IDLAB, XSD

EX = "http://ex.org/"
BUILT_INS = "http://ex.org/function/built-in.ttl#"
HEAD = f"""@prefix rml: <http://w3id.org/rml/> . @prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <{EX}> . @prefix xsd: <{XSD}> .
@prefix grel: <{GREL}> . @prefix idlab: <{IDLAB}> . @prefix bi: <{BUILT_INS}> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix old: <http://semweb.mmlab.be/ns/rml#> . @prefix fnml: <http://semweb.mmlab.be/ns/fnml#> . @prefix fno: <https://w3id.org/function/ontology#> .
"""


@dataclass
class Query:
    mapping: str
    sql: str | None = None
    quads: bool = False
    options: dict = field(default_factory=dict)
    memory: Callable[[SparkSession, str], dict] | None = None
    prepare: Callable[[SparkSession, str], str] | None = None  # a folder that {made} stands for

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        made = self.prepare(spark, sf_dir) if self.prepare else ""
        text = self.mapping.replace("{sf}", sf_dir).replace("{made}", made)
        options = {k: v.replace("{made}", made) if isinstance(v, str) else v for k, v in self.options.items()}
        engine = Engine(spark, mapping=text, memory=self.memory(spark, sf_dir) if self.memory else None, **options)
        return engine.quads() if self.quads else engine.triples()


def table(name: str) -> str:
    return f'[ rml:source "{{sf}}/{name}.parquet" ]'


def tm(name: str, source: str, subject: str, *poms: str, kind: str = "") -> str:
    """A triples map. source: a table's name or a node; subject and poms: Turtle."""
    source = table(source) if source.isidentifier() else source
    typed = f" a rml:{kind} ;" if kind else ""
    return f"<#{name}>{typed} rml:logicalSource {source} ; rml:subjectMap [ {subject} ]" + "".join(f" ;\n  rml:predicateObjectMap [ {p} ]" for p in poms) + " .\n"


def pom(p: str, o: str, g: str = "") -> str:
    return f"rml:predicate ex:{p} ; rml:objectMap [ {o} ]" + (f" ; rml:graphMap [ {g} ]" if g else "")


def t(template: str) -> str:
    return f'rml:template "{EX}{template}"'


def ref(name: str, more: str = "") -> str:
    return f'rml:reference "{name}"' + (f" ; {more}" if more else "")


# SQL of the same
def iri(prefix: str, *cols: str) -> str:
    """cols and texts between them, alternating after the prefix."""
    parts = [f"'<{EX}{prefix}'"] + [f"url_encode(cast({c} as varchar))" if k % 2 == 0 else f"'{c}'" for k, c in enumerate(cols)]
    return " || ".join([*parts, "'>'"])


def esc(x: str) -> str:
    return f"replace(replace(replace(replace(cast({x} as varchar), chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), '\"', chr(92) || '\"')"


def lit(x: str, tail: str = "''") -> str:
    return f"'\"' || {esc(x)} || '\"' || {tail}"


def typed(x: str, kind: str) -> str:
    return lit(x, f"'^^<{XSD}{kind}>'")


def select(s: str, p: str, o: str, source: str, g: str | None = None) -> str:
    pred = p if p.startswith("'") else f"'<{EX}{p}>'"
    return f"select distinct {s} as s, {pred} as p, {o} as o" + (f", {g} as g" if g else "") + f" from {source}"


def union(*parts: str) -> str:
    return " union ".join(parts)


TYPE = "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'"
Q: dict[str, Query] = {}

# --- term maps
CUSTOMER = iri("customer/", "c_custkey")
Q["term_iri_template"] = Query(HEAD + tm("A", "customer", t("customer/{c_custkey}"), pom("segment", t("segment/{c_mktsegment}/nation-{c_nationkey}"))), select(CUSTOMER, "segment", iri("segment/", "c_mktsegment", "/nation-", "c_nationkey"), "customer"))
Q["term_iri_reference"] = Query(HEAD + tm("A", "pages", t("page/{page_id}"), pom("url", ref("url", "rml:termType rml:IRI"))), select(iri("page/", "page_id"), "url", "'<' || url || '>'", "pages where url not in ('', 'nan')"))
Q["term_bnode_template"] = Query(HEAD + tm("A", "nation", 'rml:template "n{n_nationkey}" ; rml:termType rml:BlankNode', pom("name", ref("n_name"))), select("'_:n' || n_nationkey", "name", lit("n_name"), "nation"))
Q["term_literal"] = Query(HEAD + tm("A", "nation", t("nation/{n_nationkey}"), pom("name", ref("n_name")), pom("label", 'rml:template "{n_name} ({n_regionkey})" ; rml:termType rml:Literal')), union(select(iri("nation/", "n_nationkey"), "name", lit("n_name"), "nation"), select(iri("nation/", "n_nationkey"), "label", lit("n_name || ' (' || n_regionkey || ')'"), "nation")))
Q["term_constant_only"] = Query(HEAD + tm("A", "nation", "rml:constant ex:all", pom("kind", 'rml:constant "nations"')), f"select '<{EX}all>' as s, '<{EX}kind>' as p, '\"nations\"' as o")
DOC = iri("doc/", "doc_id")
TEXTS = "documents where text not in ('', 'nan')"
Q["term_lang_const"] = Query(HEAD + tm("A", "nation", t("nation/{n_nationkey}"), pom("name", ref("n_name", 'rml:language "en"'))), select(iri("nation/", "n_nationkey"), "name", lit("n_name", "'@en'"), "nation"))
Q["term_lang_ref"] = Query(HEAD + tm("A", "documents", t("doc/{doc_id}"), pom("text", ref("text", 'rml:languageMap [ rml:reference "lang" ]'))), select(DOC, "text", lit("text", "'@' || lang"), TEXTS))
Q["term_dtype_int"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}"), pom("customer", ref("o_custkey", "rml:datatype xsd:integer"))), select(iri("order/", "o_orderkey"), "customer", typed("o_custkey", "integer"), "orders"))
Q["term_dtype_int_truncates"] = Query(HEAD + tm("A", "customer", t("customer/{c_custkey}"), pom("balance", ref("c_acctbal", "rml:datatype xsd:integer"))), select(CUSTOMER, "balance", typed("cast(trunc(c_acctbal) as bigint)", "integer"), "customer"))
Q["term_dtype_bool"] = Query(HEAD + tm("A", "labels", t("doc/{doc_id}"), pom("toxic", ref("toxic", "rml:datatype xsd:boolean"))), select(DOC, "toxic", typed("toxic", "boolean"), "labels"))
Q["term_dtype_datetime"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}"), pom("date", ref("o_orderdate", "rml:datatype xsd:dateTime"))), select(iri("order/", "o_orderkey"), "date", typed("replace(cast(o_orderdate as varchar), ' ', 'T')", "dateTime"), "orders"))
Q["term_dtype_map"] = Query(HEAD + tm("A", "part", t("part/{p_partkey}"), pom("size", ref("p_size", f'rml:datatypeMap [ rml:template "{EX}type/{{p_brand}}" ]'))), select(iri("part/", "p_partkey"), "size", lit("p_size", f"'^^<{EX}type/' || url_encode(p_brand) || '>'"), "part"))
Q["term_double"] = Query(HEAD + tm("A", "part", t("part/{p_partkey}"), pom("price", ref("p_retailprice", "rml:datatype xsd:double"))), select(iri("part/", "p_partkey"), "price", typed("p_retailprice", "double"), "part"))
Q["literal_escaping"] = Query(HEAD + tm("A", "pages", t("page/{page_id}"), pom("html", ref("html"))), select(iri("page/", "page_id"), "html", lit("html"), "pages where html not in ('', 'nan')"))
Q["percent_safe"] = Query(HEAD + tm("A", "pages", t("at/{url}"), pom("id", ref("page_id"))), select(f"'<{EX}at/' || replace(replace(url_encode(url), '%3A', ':'), '%2F', '/') || '>'", "id", lit("page_id"), "pages where url not in ('', 'nan')"), options={"safe_percent_encoding": ":/"})
Q["percent_encoding"] = Query(HEAD + tm("A", "documents", t("text/{text}"), pom("id", ref("doc_id"))), select(iri("text/", "text"), "id", lit("doc_id"), TEXTS))
Q["printable_only"] = Query(HEAD + tm("A", "documents", t("doc/{doc_id}"), pom("text", ref("text"))), select(DOC, "text", lit(r"regexp_replace(text, '[\p{C}\p{Zl}\p{Zp}]|[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g')"), TEXTS), options={"only_printable_chars": True})
Q["subject_reference"] = Query(HEAD + tm("A", "pages", ref("url"), pom("id", ref("page_id"))), select("'<' || url || '>'", "id", lit("page_id"), "pages where url not in ('', 'nan')"))
Q["predicate_template"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}"), f'rml:predicateMap [ rml:template "{EX}status/{{o_orderstatus}}" ] ; rml:objectMap [ {ref("o_orderpriority")} ]'), select(iri("order/", "o_orderkey"), iri("status/", "o_orderstatus"), lit("o_orderpriority"), "orders"))
Q["array_text"] = Query(HEAD + tm("A", "events", t("event/{event_id}"), pom("props", ref("props"))), select(iri("event/", "event_id"), "props", lit("props"), "events where props not in ('', 'nan')"))

# --- graphs
ORDER = iri("order/", "o_orderkey")
Q["graph_const"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}"), pom("status", ref("o_orderstatus"), "rml:constant ex:orders")), select(ORDER, "status", lit("o_orderstatus"), "orders", f"'<{EX}orders>'"), quads=True)
Q["graph_template"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}") + f' ; rml:graphMap [ {t("priority/{o_orderpriority}")} ]', pom("status", ref("o_orderstatus"))), select(ORDER, "status", lit("o_orderstatus"), "orders", iri("priority/", "o_orderpriority")), quads=True)
Q["graph_default"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}"), pom("status", ref("o_orderstatus"), "rml:constant rml:defaultGraph")), select(ORDER, "status", lit("o_orderstatus"), "orders", "cast(null as varchar)"), quads=True)
Q["graph_several"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}") + " ; rml:graph ex:all", pom("status", ref("o_orderstatus"), t("year/{o_orderpriority}"))), union(select(ORDER, "status", lit("o_orderstatus"), "orders", f"'<{EX}all>'"), select(ORDER, "status", lit("o_orderstatus"), "orders", iri("year/", "o_orderpriority"))), quads=True)

# --- several statements of a row
PART = iri("part/", "p_partkey")
Q["class_shortcut"] = Query(HEAD + tm("A", "part", t("part/{p_partkey}") + " ; rml:class ex:Part, ex:Thing"), union(select(PART, TYPE, f"'<{EX}Part>'", "part"), select(PART, TYPE, f"'<{EX}Thing>'", "part")))
MULTI = tm("A", "part", t("part/{p_partkey}") + " ; rml:class ex:Part", pom("name", ref("p_name")), pom("brand", t("brand/{p_brand}")), pom("size", ref("p_size", "rml:datatype xsd:integer")), pom("type", ref("p_type")))
MULTI_SQL = union(select(PART, TYPE, f"'<{EX}Part>'", "part"), select(PART, "name", lit("p_name"), "part"), select(PART, "brand", iri("brand/", "p_brand"), "part"), select(PART, "size", typed("p_size", "integer"), "part"), select(PART, "type", lit("p_type"), "part"))
Q["multi_pom"] = Query(HEAD + MULTI, MULTI_SQL)
Q["multi_predicate_object"] = Query(HEAD + tm("A", "part", t("part/{p_partkey}"), f'rml:predicate ex:a, ex:b ; rml:objectMap [ {ref("p_name")} ], [ {ref("p_brand")} ]'), union(*(select(PART, p, lit(c), "part") for p in "ab" for c in ("p_name", "p_brand"))))
for _policy in ("NO", "PARTIAL-AGGREGATIONS", "MAXIMAL"):
    LINES = tm("A", "lineitem", t("order/{l_orderkey}"), pom("part", t("part/{l_partkey}")), pom("flag", ref("l_returnflag")), pom("status", ref("l_linestatus"))) + tm("B", "lineitem", t("part/{l_partkey}"), pom("supplier", t("supplier/{l_suppkey}")), pom("flag", ref("l_returnflag")))
    L, P = iri("order/", "l_orderkey"), iri("part/", "l_partkey")
    Q["partition_" + {"NO": "none", "MAXIMAL": "maximal"}.get(_policy, "partial")] = Query(HEAD + LINES, union(select(L, "part", P, "lineitem"), select(L, "flag", lit("l_returnflag"), "lineitem"), select(L, "status", lit("l_linestatus"), "lineitem"), select(P, "supplier", iri("supplier/", "l_suppkey"), "lineitem"), select(P, "flag", lit("l_returnflag"), "lineitem")), options={"mapping_partitioning": _policy})
Q["distinct_statements"] = Query(HEAD + tm("A", "lineitem", t("flag/{l_returnflag}"), pom("status", ref("l_linestatus"))), select(iri("flag/", "l_returnflag"), "status", lit("l_linestatus"), "lineitem"))
Q["null_filter_rule_level"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}"), pom("status", ref("o_orderstatus")), pom("both", 'rml:template "{o_orderstatus}-{o_orderpriority}" ; rml:termType rml:Literal')), union(select(ORDER, "status", lit("o_orderstatus"), "orders where o_orderstatus not in ('F', '')"), select(ORDER, "both", lit("o_orderstatus || '-' || o_orderpriority"), "orders where o_orderstatus not in ('F', '') and o_orderpriority not in ('F', '')")), options={"na_values": ("F", "")})

# --- joins


def join(parent: str, *pairs: tuple[str, str]) -> str:
    return f"rml:parentTriplesMap <#{parent}>" + "".join(f' ; rml:joinCondition [ rml:child "{c}" ; rml:parent "{p}" ]' for c, p in pairs)


CUST = tm("C", "customer", t("customer/{c_custkey}"))
Q["join_single"] = Query(HEAD + CUST + tm("O", "orders", t("order/{o_orderkey}"), pom("customer", join("C", ("o_custkey", "c_custkey")))), select(ORDER, "customer", CUSTOMER, "orders join customer on o_custkey = c_custkey"))
Q["join_multi_key"] = Query(HEAD + tm("P", "lineitem", t("line/{l_orderkey}/{l_linenumber}")) + tm("L", "[ rml:query \"select l_orderkey as ok, l_linenumber as ln, l_shipdate as sd from '{sf}/lineitem.parquet'\" ]", t("ship/{ok}-{ln}"), pom("of", join("P", ("ok", "l_orderkey"), ("ln", "l_linenumber")))), select(iri("ship/", "l_orderkey", "-", "l_linenumber"), "of", iri("line/", "l_orderkey", "/", "l_linenumber"), "lineitem"))
Q["self_join_elim"] = Query(HEAD + tm("P", "orders", t("customer/{o_custkey}")) + tm("L", "orders", t("order/{o_orderkey}"), pom("by", join("P", ("o_orderkey", "o_orderkey"))), pom("by2", join("P"))), union(select(ORDER, "by", iri("customer/", "o_custkey"), "orders"), select(ORDER, "by2", iri("customer/", "o_custkey"), "orders")))
Q["join_fanout_distinct"] = Query(HEAD + tm("P", "orders", t("priority/{o_orderpriority}")) + tm("L", "customer", t("customer/{c_custkey}"), pom("ordered", join("P", ("c_custkey", "o_custkey")))), select(CUSTOMER, "ordered", iri("priority/", "o_orderpriority"), "customer join orders on o_custkey = c_custkey"))
Q["join_two_hop"] = Query(HEAD + tm("R", "region", t("region/{r_regionkey}")) + tm("N", "nation", t("nation/{n_nationkey}"), pom("in", join("R", ("n_regionkey", "r_regionkey")))) + tm("C", "customer", t("customer/{c_custkey}"), pom("nation", join("N", ("c_nationkey", "n_nationkey")))), union(select(iri("nation/", "n_nationkey"), "in", iri("region/", "r_regionkey"), "nation join region on n_regionkey = r_regionkey"), select(CUSTOMER, "nation", iri("nation/", "n_nationkey"), "customer join nation on c_nationkey = n_nationkey")))
Q["join_big"] = Query(HEAD + tm("O", "orders", t("order/{o_orderkey}/{o_orderstatus}")) + tm("L", "lineitem", t("line/{l_orderkey}/{l_linenumber}"), pom("order", join("O", ("l_orderkey", "o_orderkey")))), select(iri("line/", "l_orderkey", "/", "l_linenumber"), "order", iri("order/", "o_orderkey", "/", "o_orderstatus"), "lineitem join orders on l_orderkey = o_orderkey"))
Q["join_bnode_parent"] = Query(HEAD + tm("N", "nation", 'rml:template "nat{n_nationkey}" ; rml:termType rml:BlankNode') + tm("S", "supplier", t("supplier/{s_suppkey}"), pom("nation", join("N", ("s_nationkey", "n_nationkey")))), select(iri("supplier/", "s_suppkey"), "nation", "'_:nat' || n_nationkey", "supplier join nation on s_nationkey = n_nationkey"))

# --- quoted statements
SUPP = iri("supplier/", "s_suppkey")


def quote(s: str, p: str, o: str) -> str:
    return f"'<< ' || {s} || ' <{EX}{p}> ' || {o} || ' >>'"


NAMED = tm("N", "supplier", t("supplier/{s_suppkey}"), pom("name", ref("s_name")))
Q["star_subject"] = Query(HEAD + NAMED + tm("Q", "supplier", "rml:quotedTriplesMap <#N>", pom("nation", ref("s_nationkey"))), union(select(SUPP, "name", lit("s_name"), "supplier"), select(quote(SUPP, "name", lit("s_name")), "nation", lit("s_nationkey"), "supplier")))
Q["star_object"] = Query(HEAD + NAMED + tm("Q", "supplier", t("nation/{s_nationkey}"), pom("says", "rml:quotedTriplesMap <#N>")), union(select(SUPP, "name", lit("s_name"), "supplier"), select(iri("nation/", "s_nationkey"), "says", quote(SUPP, "name", lit("s_name")), "supplier")))
Q["star_non_asserted"] = Query(HEAD + NAMED.replace("<#N>", "<#N> a rml:NonAssertedTriplesMap ;", 1) + tm("Q", "supplier", "rml:quotedTriplesMap <#N>", pom("nation", ref("s_nationkey"))), select(quote(SUPP, "name", lit("s_name")), "nation", lit("s_nationkey"), "supplier"))
INNER = quote(SUPP, "name", lit("s_name"))
Q["star_nested"] = Query(HEAD + NAMED.replace("<#N>", "<#N> a rml:NonAssertedTriplesMap ;", 1) + tm("Q", "supplier", "rml:quotedTriplesMap <#N>", pom("nation", ref("s_nationkey")), kind="NonAssertedTriplesMap") + tm("Z", "supplier", "rml:quotedTriplesMap <#Q>", pom("key", ref("s_suppkey"))), select(quote(INNER, "nation", lit("s_nationkey")), "key", lit("s_suppkey"), "supplier"))
Q["star_join"] = Query(HEAD + tm("N", "nation", t("nation/{n_nationkey}"), pom("name", ref("n_name")), kind="NonAssertedTriplesMap") + tm("Q", "supplier", t("supplier/{s_suppkey}"), pom("knows", 'rml:quotedTriplesMap <#N> ; rml:joinCondition [ rml:child "s_nationkey" ; rml:parent "n_nationkey" ]')), select(SUPP, "knows", quote(iri("nation/", "n_nationkey"), "name", lit("n_name")), "supplier join nation on s_nationkey = n_nationkey"))

# --- functions


def fx(function: str, *args: tuple[str, str]) -> str:
    """A function-valued map: arguments (parameter, Turtle of the value map)."""
    own = " , ".join(f"[ rml:parameter {p} ; rml:inputValueMap [ {v} ] ]" for p, v in args)
    return f"rml:functionExecution [ rml:function {function}" + (f" ; rml:input {own}" if own else "") + " ]"


def const(x: str) -> str:
    return f"rml:constant {json.dumps(x)}"


def fn_query(name: str, source: str, key: str, function: str, args: list[tuple[str, str]], sql: str | None, where: str = "true") -> None:
    text = HEAD + tm("A", source, t(source + "/{" + key + "}"), pom("out", fx(function, *args)))
    own = f"(select {key}, {sql} as x from {source}) where x is not null and x not in ('', 'nan')" if sql else None
    Q["fn_" + name] = Query(text, select(iri(source + "/", key), "out", lit("x"), own) if sql else None)


G = "grel:"
V, SUB = G + "valueParameter", G + "string_sub"
ARR = G + "p_array_a"
N1, N2, I1, I2 = G + "p_dec_n", G + "param_n2", G + "p_int_i", G + "p_int_i2"
NAME, SIZE, PRICE, PKEY, BRAND, PTYPE = (ref(c) for c in ("p_name", "p_size", "p_retailprice", "p_partkey", "p_brand", "p_type"))


def part(name: str, function: str, args: list[tuple[str, str]], sql: str | None) -> None:
    fn_query(name, "part", "p_partkey", function, args, sql)


SPLIT = (ARR, fx(G + "string_split", (V, PTYPE), (G + "p_string_sep", const(" "))))
WORDS = "string_split(p_type, ' ')"
BOOL = "case when {} then 'true' else 'false' end"
part("toUpperCase", G + "toUpperCase", [(V, NAME)], "upper(p_name)")
part("toLowerCase", G + "toLowerCase", [(V, PTYPE)], "lower(p_type)")
part("string_length", G + "string_length", [(V, NAME)], "cast(length(p_name) as varchar)")
part("reverse", G + "reverse", [(V, NAME)], "reverse(p_name)")
part("string_replace", G + "string_replace", [(V, NAME), (G + "p_string_find", const("a")), (G + "p_string_replace", const("_"))], "replace(p_name, 'a', '_')")
part("string_replaceChars", G + "string_replaceChars", [(V, NAME), (G + "p_string_find", const("e")), (G + "p_string_replace", const("3"))], "replace(p_name, 'e', '3')")
part("string_contains", G + "string_contains", [(V, PTYPE), (SUB, const("E"))], BOOL.format("contains(p_type, 'E')"))
part("string_startsWith", G + "string_startsWith", [(V, BRAND), (SUB, const("Brand#1"))], BOOL.format("starts_with(p_brand, 'Brand#1')"))
part("string_endsWith", G + "string_endsWith", [(V, BRAND), (SUB, const("1"))], BOOL.format("ends_with(p_brand, '1')"))
part("string_indexOf", G + "string_indexOf", [(V, NAME), (SUB, const("a"))], "cast(strpos(p_name, 'a') - 1 as varchar)")
part("string_lastIndexOf", G + "string_lastIndexOf", [(V, NAME), (SUB, const("a"))], "cast(case when contains(p_name, 'a') then length(p_name) - strpos(reverse(p_name), 'a') else -1 end as varchar)")
part("string_trim", G + "string_trim", [(V, 'rml:template "  {p_name} "')], "trim(p_name)")
part("string_substring", G + "string_substring", [(V, NAME), (G + "param_int_i_from", const("2")), (G + "param_int_i_opt_to", const("-1"))], "p_name[3:-2]")
part("string_chomp", G + "string_chomp", [(V, BRAND), (G + "p_string_sep", const("3"))], "case when ends_with(p_brand, '3') then left(p_brand, length(p_brand) - 1) else p_brand end")
part("string_diff", G + "string_diff", [(V, const("Brand#")), (G + "valueParameter2", BRAND)], "case when starts_with(p_brand, 'Brand#') then substr(p_brand, 7) else p_brand end")
part("string_toNumber", G + "string_toNumber", [(G + "p_any_e", PRICE)], "cast(p_retailprice as varchar)")
part("string_toString", G + "string_toString", [(G + "p_any_e", SIZE)], "cast(p_size as varchar)")
part("string_split", G + "string_split", [(V, PTYPE), (G + "p_string_sep", const(" "))], f"unnest({WORDS})")
part("string_smartSplit", G + "string_smartSplit", [(V, 'rml:template "{p_size},{p_brand}"')], "unnest([cast(p_size as varchar), p_brand])")
part("string_splitByCharType", G + "string_splitByCharType", [(V, BRAND)], r"unnest(regexp_extract_all(p_brand, '[0-9]|\s|[a-z]+|[A-Z]+'))")
part("string_splitByLengths", G + "string_splitByLengths", [(V, BRAND), (I1, const("2")), (I2, const("3"))], "unnest([substr(p_brand, 1, 2), substr(p_brand, 3, 3)])")
part("string_partition", G + "string_partition", [(V, BRAND), (G + "p_fragment", const("#"))], "unnest([string_split(p_brand, '#')[1], '#', string_split(p_brand, '#')[2]])")
part("string_rpartition", G + "string_rpartition", [(V, NAME), (G + "p_fragment", const(" ")), (G + "p_bool_opt_b", const("true"))], "unnest(case when contains(p_name, ' ') then [left(p_name, length(p_name) - strpos(reverse(p_name), ' ')), right(p_name, strpos(reverse(p_name), ' ') - 1)] else ['', p_name] end)")
part("string_match", G + "string_match", [(V, BRAND), (G + "p_string_regex", const("[0-9]"))], "unnest(regexp_extract_all(p_brand, '[0-9]'))")
part("string_toTitlecase", G + "string_toTitlecase", [(V, PTYPE)], "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')")
part("escape_html", G + "escape", [(V, 'rml:template "<{p_brand}> & \\"x\\""'), (G + "modeParameter", const("html"))], "'&lt;' || p_brand || '&gt; &amp; &quot;x&quot;'")
part("escape_url", G + "escape", [(V, NAME), (G + "modeParameter", const("url"))], "replace(url_encode(p_name), '%2F', '/')")
part("string_unescape", G + "string_unescape", [(V, 'rml:template "&lt;{p_brand}&gt;"'), (G + "modeParameter", const("html"))], "'<' || p_brand || '>'")
part("concat", "bi:concat", [("bi:valueParameter1", BRAND), ("bi:valueParameter2", SIZE), (G + "p_string_sep", const("-"))], "p_brand || '-' || p_size")
part("string_split_explode", "bi:string_split_explode", [(V, PTYPE), (G + "p_string_sep", const(" "))], f"unnest({WORDS})")
part("string_md5", G + "string_md5", [(V, NAME)], "md5(p_name)")
part("string_sha1", G + "string_sha1", [(V, NAME)], "sha1(p_name)")
part("hash", "bi:hash", [(V, NAME)], "sha256(p_name)")
part("hash_iri", "bi:hash_iri", [(V, NAME)], "'http://example.com/ns#' || sha256(p_name)")
part("unicodestring", G + "unicodestring-s", [(V, BRAND)], "cast(unnest(list_transform(string_split(p_brand, ''), lambda c: unicode(c))) as varchar)")
part("other_type", G + "other_type", [(G + "p_any_e", NAME)], "'str'")
part("toUpperCaseURL", "idlab:toUpperCaseURL", [("idlab:str", 'rml:template "ex.org/{p_brand}"')], "'http://EX.ORG/' || upper(p_brand)")
part("uuid", "bi:uuid", [], None)
part("other_coalesce", "bi:other_coalesce", [("bi:p_any_rep_e", const("")), ("bi:p_any_rep_e", BRAND), ("bi:p_any_rep_e", NAME)], "p_brand")
part("array_get", G + "array_get", [SPLIT, (G + "param_int_i_from", const("0"))], f"{WORDS}[1]")
part("array_slice", G + "array_slice", [SPLIT, (G + "param_int_i_from", const("0")), (G + "param_int_i_opt_to", const("2"))], f"'[''' || array_to_string({WORDS}[1:2], ''', ''') || ''']'")
part("array_length", G + "array_length", [SPLIT], f"cast(len({WORDS}) as varchar)")
part("array_sum", G + "array_sum", [(ARR, fx(G + "string_splitByCharType", (V, BRAND)))], "cast(list_sum(list_transform(regexp_extract_all(p_brand, '[0-9]'), lambda x: cast(x as bigint))) as varchar)")
part("array_join", G + "array_join", [SPLIT, (G + "p_string_sep", const("+"))], "replace(p_type, ' ', '+')")
part("array_reverse", G + "array_join", [(ARR, fx(G + "array_reverse", SPLIT)), (G + "p_string_sep", const("+"))], f"array_to_string(list_reverse({WORDS}), '+')")
part("array_uniques", G + "array_length", [(ARR, fx(G + "array_uniques", (ARR, fx(G + "string_splitByCharType", (V, BRAND)))))], "cast(len(list_distinct(regexp_extract_all(p_brand, '[A-Z]+|[a-z]+|[0-9]'))) as varchar)")
part("array_sort", G + "array_join", [(ARR, fx(G + "array_sort", SPLIT)), (G + "p_string_sep", const("+"))], f"array_to_string(list_sort({WORDS}), '+')")
TEST = fx(G + "string_startsWith", (V, BRAND), (SUB, const("Brand#1")))
part("controls_if", G + "controls_if", [(G + "bool_b", TEST), (G + "any_true", NAME), (G + "any_false", const("no"))], "case when starts_with(p_brand, 'Brand#1') then p_name else 'no' end")
part("controls_if_condition", G + "controls_if", [(G + "bool_b", 'rml:template "{p_size} > 25"'), (G + "any_true", const("big")), (G + "any_false", const("small"))], "case when p_size > 25 then 'big' else 'small' end")
part("controls_if_cast", "bi:controls_if_cast", [(G + "bool_b", const("yes")), (G + "any_true", NAME), (G + "any_false", const("no"))], "p_name")
END = fx(G + "string_endsWith", (V, BRAND), (SUB, const("1")))
for _op, _sql in (("and", "{a} and {b}"), ("or", "{a} or {b}"), ("xor", "({a}) <> ({b})")):
    part(f"boolean_{_op}", G + f"boolean_{_op}", [(G + "param_rep_b", TEST), (G + "param_rep_b", END)], BOOL.format(_sql.format(a="starts_with(p_brand, 'Brand#1')", b="ends_with(p_brand, '1')")))
part("boolean_not", G + "boolean_not", [(G + "bool_b", TEST)], BOOL.format("not starts_with(p_brand, 'Brand#1')"))
part("trueCondition", "idlab:trueCondition", [("idlab:str", NAME), ("idlab:strBoolean", TEST)], "case when starts_with(p_brand, 'Brand#1') then p_name end")
for _f in ("abs", "ceil", "floor"):
    part(f"math_{_f}", G + f"math_{_f}", [(N1, PRICE)], "cast(p_retailprice as varchar)" if _f == "abs" else f"cast(cast({_f}(p_retailprice) as bigint) as varchar)")
for _f in ("sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "exp", "degrees", "radians", "ln"):
    part(f"math_{_f}", G + f"math_{_f}", [(N1, SIZE)], f"cast({_f}(cast(p_size as double)) as varchar)")
part("math_log", G + "math_log", [(N1, SIZE)], "cast(log10(cast(p_size as double)) as varchar)")
for _f in ("acos", "asin"):
    part(f"math_{_f}", G + f"math_{_f}", [(N1, 'rml:template "0.{p_size}"')], f"cast({_f}(cast('0.' || p_size as double)) as varchar)")
part("math_atan2", G + "math_atan2", [(N1, SIZE), (N2, PKEY)], "cast(atan2(cast(p_size as double), cast(p_partkey as double)) as varchar)")
part("math_even", G + "math_even", [(N1, SIZE)], "case when p_size % 2 = 0 then 'True' else 'False' end")
part("math_odd", G + "math_odd", [(N1, SIZE)], "case when p_size % 2 = 1 then 'True' else 'False' end")
part("math_fact", G + "math_fact", [(I1, fx(G + "math_mod", (I1, SIZE), (I2, const("20"))))], "cast(factorial(cast(p_size % 20 as integer)) as varchar)")
part("math_factn", G + "math_factn", [(I1, const("1")), (I2, fx(G + "math_mod", (I1, SIZE), (I2, const("10"))))], "cast(cast(coalesce(list_product(range(least(1, p_size % 10), greatest(1, p_size % 10))), 1) as bigint) as varchar)")
part("math_gcd", G + "math_gcd", [(I1, SIZE), (I2, PKEY)], "cast(gcd(p_size, p_partkey) as varchar)")
part("math_lcm", G + "math_lcm", [(I1, SIZE), (I2, PKEY)], "cast(lcm(p_size, p_partkey) as varchar)")
part("math_combin", G + "math_combin", [(I1, SIZE), (I2, const("2"))], "cast(p_size * (p_size - 1) // 2 as varchar)")
part("math_mod", G + "math_mod", [(I1, PKEY), (I2, SIZE)], "cast(p_partkey % p_size as varchar)")
part("math_multinomial", G + "math_multinomial", [(ARR, fx(G + "math_mod", (I1, SIZE), (I2, const("7")))), (ARR, const("3"))], "cast(factorial(cast(p_size % 7 as integer) + 3) // factorial(cast(p_size % 7 as integer)) // 6 as varchar)")
part("math_pow", G + "math_pow", [(N1, SIZE), (G + "p_any_exp", const("2"))], "cast(power(cast(p_size as double), 2) as varchar)")
part("math_quotient", G + "math_quotient", [(N1, PKEY), (N2, SIZE)], "cast(cast(floor(cast(p_partkey as double) / p_size) as bigint) as varchar)")
part("math_max", G + "math_max", [(N1, SIZE), (N2, const("25"))], "cast(greatest(p_size, 25) as varchar)")
part("math_min", G + "math_min", [(N1, SIZE), (N2, const("25"))], "cast(least(p_size, 25) as varchar)")
part("math_randomNumber", G + "math_randomNumber", [(I1, const("1")), (I2, const("9"))], None)
part("math_round", G + "math_round", [(N1, PRICE)], "cast(cast(round_even(p_retailprice, 0) as bigint) as varchar)")
ODATE = ref("o_orderdate")


def order(name: str, function: str, args: list[tuple[str, str]], sql: str | None) -> None:
    fn_query(name, "orders", "o_orderkey", function, args, sql)


DAY = fx(G + "string_substring", (V, ODATE), (G + "param_int_i_from", const("0")), (G + "param_int_i_opt_to", const("10")))
order("date_toDate", G + "date_toDate", [(V, DAY), (G + "p_string_pattern", const("yyyy-MM-dd"))], "strftime(o_orderdate, '%Y-%m-%dT00:00:00')")
order("date_toDate_python", "bi:date_toDate", [("bi:valueParameter", DAY), ("bi:p_string_pattern", const("%Y-%m-%d"))], "strftime(o_orderdate, '%Y-%m-%dT00:00:00')")
order("date_now", G + "date_now", [], None)
order("date_diff", G + "date_diff", [(G + "p_datetime_d", ODATE), (G + "p_datetime_d2", const("2000-01-01T00:00:00")), (G + "p_string_timeunit", const("d"))], "cast(cast(floor(abs(epoch(o_orderdate) - epoch(timestamp '2000-01-01')) / 86400) as bigint) as varchar)")
for _u, _sql in (("year", "year(o_orderdate)"), ("month", "month(o_orderdate)"), ("day", "day(o_orderdate)"), ("hour", "hour(o_orderdate)"), ("weekday", "dayname(o_orderdate)"), ("week", "(day(o_orderdate) - 1) // 7 + 1"), ("time", "epoch_ms(o_orderdate)")):
    order(f"date_datePart_{_u}", G + "date_datePart", [(G + "p_date_d", ODATE), (G + "p_string_unit", const(_u))], f"cast({_sql} as varchar)")
order("date_inc", G + "date_inc", [(G + "p_date_d", DAY), (G + "p_dec_n", const("1")), (G + "p_string_unit", const("month"))], "strftime(date_trunc('day', o_orderdate) + interval 1 month, '%Y-%m-%dT00:00:00')")
Q["fn_nested"] = Query(HEAD + tm("A", "part", t("part/{p_partkey}"), pom("out", fx(G + "toUpperCase", (V, fx(G + "reverse", (V, NAME)))))), select(PART, "out", lit("upper(reverse(p_name))"), "part"))
Q["fn_explode"] = Query(HEAD + tm("A", "documents", t("doc/{doc_id}"), pom("line", fx(G + "string_split", (V, ref("text")), (G + "p_string_sep", 'rml:constant "\\n"')))), select(DOC, "line", lit("x"), "(select doc_id, unnest(string_split(text, chr(10))) as x from documents where text not in ('', 'nan')) where x not in ('', 'nan')"))
Q["fn_conditional"] = Query(HEAD + tm("A", "orders", t("order/{o_orderkey}"), pom("urgent", fx("idlab:trueCondition", ("idlab:str", ref("o_custkey")), ("idlab:strBoolean", fx(G + "string_startsWith", (V, ref("o_orderpriority")), (SUB, const("1-"))))))), select(ORDER, "urgent", lit("o_custkey"), "orders where starts_with(o_orderpriority, '1-')"))
Q["fn_subject"] = Query(HEAD + tm("A", "part", fx("bi:hash_iri", (V, NAME)), pom("size", ref("p_size"))), select("'<http://example.com/ns#' || sha256(p_name) || '>'", "size", lit("p_size"), "part"))
Q["fn_predicate_graph"] = Query(HEAD + tm("A", "part", t("part/{p_partkey}"), f"rml:predicateMap [ {fx('bi:hash_iri', (V, BRAND))} ] ; rml:objectMap [ {SIZE} ] ; rml:graphMap [ {fx('bi:hash_iri', (V, PTYPE))} ]"), f"select distinct {PART} as s, '<http://example.com/ns#' || sha256(p_brand) || '>' as p, {lit('p_size')} as o, '<http://example.com/ns#' || sha256(p_type) || '>' as g from part", quads=True)
Q["fn_language"] = Query(HEAD + tm("A", "documents", t("doc/{doc_id}"), pom("source", ref("source", f"rml:languageMap [ {fx(G + 'toLowerCase', (V, ref('lang')))} ]"))), select(DOC, "source", lit("source", "'@' || lower(lang)"), "documents where source not in ('', 'nan') and lang not in ('', 'nan')"))


# --- files made from the tables
def made_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; in a temporary one where none is set and all runs in one process."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tripleloom-")
    return f"{root.rstrip('/')}/made-{uuid.uuid4().hex}"


def made_files(spark: SparkSession, sf_dir: str) -> str:
    """nation and region as CSV, ORC, JSON and XML in the shared folder (a temporary one where none is set)."""
    root = made_folder(spark)
    for name in ("nation", "region"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet").coalesce(1)
        df.write.option("header", True).csv(f"{root}/{name}.csv")
        df.write.option("header", True).option("sep", ";").csv(f"{root}/{name}_semicolon.csv")
        df.write.option("header", True).option("sep", "\t").csv(f"{root}/{name}.tsv")
        df.write.orc(f"{root}/{name}.orc")
        df.write.json(f"{root}/{name}.jsonl")
        rows = F.collect_list(F.struct(*df.columns))
        df.agg(F.to_json(F.struct(rows.alias("rows"))).alias("value")).coalesce(1).write.text(f"{root}/{name}.json")
        own = F.concat(F.lit("<row>"), *(F.concat(F.lit(f"<{c}>"), F.col(c).cast("string"), F.lit(f"</{c}>")) for c in df.columns), F.lit("</row>"))
        df.agg(F.concat(F.lit("<rows>"), F.concat_ws("", F.collect_list(own)), F.lit("</rows>")).alias("value")).coalesce(1).write.text(f"{root}/{name}.xml")
    return root


def nation_scan(source: str) -> str:
    return HEAD + tm("A", source, t("nation/{n_nationkey}"), pom("name", ref("n_name")), pom("region", t("region/{n_regionkey}")))


NATION = union(select(iri("nation/", "n_nationkey"), "name", lit("n_name"), "nation"), select(iri("nation/", "n_nationkey"), "region", iri("region/", "n_regionkey"), "nation"))
Q["scan_parquet"] = Query(nation_scan("nation"), NATION)
for _name, _source in {
    "csv": '[ rml:source "{made}/nation.csv" ; rml:referenceFormulation rml:CSV ]', "csv_delimiter": '[ rml:source "{made}/nation_semicolon.csv" ]', "tsv": '[ rml:source "{made}/nation.tsv" ]', "orc": '[ rml:source "{made}/nation.orc" ]',
    "json": '[ rml:source "{made}/nation.json" ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$.rows[*]" ]', "json_lines": '[ rml:source "{made}/nation.jsonl" ; rml:iterator "$" ]', "xml": '[ rml:source "{made}/nation.xml" ; rml:referenceFormulation rml:XPath ; rml:iterator "/rows/row" ]',
}.items():
    Q["scan_" + _name] = Query(nation_scan(_source), NATION, prepare=made_files)
Q["mem_dataframe"] = Query(nation_scan('[ rml:source [ <https://w3id.org/okn/o/sd#name> "nations" ] ]'), NATION, memory=lambda spark, d: {"nations": spark.read.parquet(f"{d}/nation.parquet")})
Q["mem_pandas"] = Query(nation_scan('[ rml:source "{nations}" ]'), NATION, memory=lambda spark, d: {"nations": spark.read.parquet(f"{d}/nation.parquet").toPandas()})
Q["mem_dict"] = Query(nation_scan('[ rml:source "{nations}" ; rml:referenceFormulation rml:JSONPath ; rml:iterator "$.rows[*]" ]'), NATION, memory=lambda spark, d: {"nations": {"rows": [r.asDict() for r in spark.read.parquet(f"{d}/nation.parquet").collect()]}})
Q["scan_tables_by_name"] = Query(nation_scan('[ rml:tableName "loom_nation" ]'), NATION, prepare=lambda spark, d: spark.read.parquet(f"{d}/nation.parquet").createOrReplaceTempView("loom_nation") or "")
Q["json_reference"] = Query(HEAD + tm("A", '[ rml:query "select event_id, get_json_object(props, \'$.k\') as k from \'{sf}/events.parquet\'" ]', t("event/{event_id}"), pom("k", ref("k"))), select(iri("event/", "event_id"), "k", lit("x"), "(select event_id, json_extract_string(props, '$.k') as x from events) where x not in ('', 'nan')"))


def temporary() -> str:
    """A folder of the driver's machine, for what the driver alone reads: databases in a file, files of functions."""
    import tempfile

    return tempfile.mkdtemp(prefix="tripleloom-")


def made_database(spark: SparkSession, sf_dir: str) -> str:
    """orders in a SQLite table: whole and broken numbers, text with nulls, a date, a truth value, bytes."""
    import os
    import sqlite3
    from urllib.parse import unquote, urlparse

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_totalprice", "nullif(o_orderstatus, 'P')", "cast(date(o_orderdate) as string)", "int(o_orderpriority like '1%')", "cast(o_orderstatus as binary)")

    def fill(at: str, batches) -> None:
        con = sqlite3.connect(at)
        con.execute("pragma synchronous = off")
        con.execute("create table orders (k integer primary key, total double, status varchar(5), day date, urgent boolean, mark varbinary(9))")
        for batch in batches:
            con.executemany("insert into orders values (?, ?, ?, ?, ?, ?)", batch)
        con.commit()
        con.close()

    root = urlparse(made_folder(spark))
    if root.scheme not in ("", "file"):  # no path that SQLite could write to
        at = temporary()
        fill(f"{at}/orders.db", ([(*r[:5], r[5] and bytes(r[5]))] for r in rows.toLocalIterator()))
        return at
    at = unquote(root.path)

    def write(batches):
        """One task writes the file; an attempt has its own, which takes the name when it is whole."""
        import uuid

        own = f"{at}/{uuid.uuid4().hex}"
        os.makedirs(at, exist_ok=True)
        fill(own, (zip(*(c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in b.columns)) for b in batches))
        os.replace(own, f"{at}/orders.db")
        yield from ()

    rows.coalesce(1).mapInArrow(write, "none int").count()
    return at


def made_documents(spark: SparkSession, sf_dir: str) -> str:
    """Customers with their orders, as JSON with nested lists and missing keys, and as XML with attributes."""
    root = made_folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")).alias("o"))
    own = orders.groupBy("id").agg(F.collect_list("o").alias("orders"))
    own.select(F.to_json(F.struct("id", F.struct(F.col("orders").alias("list")).alias("own"))).alias("value")).write.text(f"{root}/customers.jsonl")
    each = F.transform("orders", lambda o: F.concat(F.lit('<order key="'), o["key"].cast("string"), F.lit('"'), F.coalesce(F.concat(F.lit(' status="'), o["status"], F.lit('"')), F.lit("")), F.lit("/>")))
    line = F.concat(F.lit('<customer id="'), F.col("id").cast("string"), F.lit('">'), F.array_join(each, ""), F.lit("</customer>"))

    def document(batches):
        """One document of all lines, which pass by."""
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["<all>"])], ["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</all>"])], ["value"])

    own.select(line.alias("value")).repartition(1).mapInArrow(document, "value string").write.text(f"{root}/customers.xml")
    return root


def made_functions(spark: SparkSession, sf_dir: str) -> str:
    at = temporary()
    with open(f"{at}/own.py", "w") as f:
        f.write("""
@udf(fun_id="http://ex.org/label", text="http://ex.org/text", size="http://ex.org/size")
def label(text, size):
    return None if int(size) > 40 else f"{text.upper()} ({int(size) * 2})"


@udf(fun_id="http://ex.org/parts", text="http://ex.org/text")
def parts(text):
    return text.split(" ")
""")
    return at


_O = "(select o_orderkey, nullif(o_orderstatus, 'P') as status, o_totalprice, cast(cast(o_orderdate as date) as varchar) as day, o_orderpriority like '1%' as urgent, hex(o_orderstatus::blob) as mark from orders)"
_KEY = iri("order/", "o_orderkey")
Q["scan_sqlite"] = Query(
    HEAD + tm("A", '[ rml:tableName "orders" ]', t("order/{k}"), *(pom(x, ref(x)) for x in ("total", "status", "day", "urgent", "mark"))),
    union(select(_KEY, "total", lit("o_totalprice"), _O), select(_KEY, "status", lit("status"), f"{_O} where status is not null"), select(_KEY, "day", lit("day"), _O), select(_KEY, "urgent", lit("case when urgent then 'True' else 'False' end"), _O), select(_KEY, "mark", lit("mark"), _O)),
    options={"db_url": "sqlite:///{made}/orders.db"}, prepare=made_database)
Q["scan_sqlite_query"] = Query(HEAD + tm("A", '[ rml:query "select k, status from orders where urgent = 1" ]', t("order/{k}"), pom("status", ref("status"))), select(_KEY, "status", lit("status"), f"{_O} where urgent and status is not null"), options={"db_url": "sqlite:///{made}/orders.db"}, prepare=made_database)
_NESTED = '[ rml:source "{made}/customers.%s" ; rml:referenceFormulation rml:%s ; rml:iterator "%s" ]'
_CUSTOMER_ORDER = union(select(iri("customer/", "o_custkey"), "placed", iri("order/", "o_orderkey"), "orders"), select(iri("order/", "o_orderkey"), "status", lit("o_orderstatus"), "orders where o_orderstatus <> 'P'"))
Q["scan_json_nested"] = Query(HEAD + tm("A", _NESTED % ("jsonl", "JSONPath", "$"), t("customer/{id}"), pom("placed", t("order/{own.list[*].key}"))) + tm("B", _NESTED % ("jsonl", "JSONPath", "$.own.list[*]"), t("order/{key}"), pom("status", ref("status"))), _CUSTOMER_ORDER, prepare=made_documents)
Q["scan_xml_attributes"] = Query(HEAD + tm("A", _NESTED % ("xml", "XPath", "/all/customer"), t("customer/{@id}"), pom("placed", t("order/{order/@key}"))) + tm("B", _NESTED % ("xml", "XPath", "/all/customer/order"), t("order/{@key}"), pom("status", ref("@status"))), _CUSTOMER_ORDER, prepare=made_documents)
Q["fn_user_file"] = Query(
    HEAD + tm("A", "part", t("part/{p_partkey}"), pom("label", fx("ex:label", ("ex:text", ref("p_name")), ("ex:size", ref("p_size")))), pom("part", fx("ex:parts", ("ex:text", ref("p_type"))))),
    union(select(iri("part/", "p_partkey"), "label", lit("upper(p_name) || ' (' || p_size * 2 || ')'"), "part where p_size <= 40"), select(iri("part/", "p_partkey"), "part", lit("x"), "(select p_partkey, unnest(string_split(p_type, ' ')) as x from part)")),
    options={"udfs": "{made}/own.py"}, prepare=made_functions)


def sink(name: str, write: Callable) -> None:
    """The lines that a sink wrote, read back, with their terms parted."""
    base = Q["join_single"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{made_folder(spark)}/out"
        write(Engine(spark, mapping=base.mapping.replace("{sf}", sf_dir)), path)
        line = r"^(\S+) (\S+) (.*) \.$"
        return spark.read.option("recursiveFileLookup", "true").text(path).select(*(F.regexp_extract("value", line, k).alias(c) for k, c in enumerate(("s", "p", "o"), 1))).distinct()

    run.sql, run.mapping = base.sql, base.mapping
    Q["sink_" + name] = run


# --- SQL views
def view(name: str, query: str, subject: str, predicate: str, reference: str, sql: str | None = None) -> None:
    """query: SQL in which {table} stands for a file; sql: the same for the views of the tables."""
    import re

    files = re.sub(r"\{(\w+)\}", lambda m: f"'{{sf}}/{m[1]}.parquet'", query)
    own = sql or re.sub(r"\{(\w+)\}", lambda m: m[1], query)
    key = subject.split("{")[1].split("}")[0]
    Q["view_" + name] = Query(HEAD + tm("A", f"[ rml:query {json.dumps(files)} ]", t(subject), pom(predicate, ref(reference))), select(iri(subject.split("{")[0], key), predicate, lit("x"), f"(select {key}, cast({reference} as varchar) as x from ({own})) where {key} is not null and x is not null and x not in ('', 'nan')"))


view("join_agg", "select n_name, count(*) as n from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey group by n_name", "nation/{n_name}", "customers", "n")
view("case", "select p_partkey, case when p_size > 25 then 'big' else 'small' end as kind from {part}", "part/{p_partkey}", "kind", "kind")
view("where", "select c_custkey, c_name from {customer} where c_acctbal > 0 and c_mktsegment = 'BUILDING'", "customer/{c_custkey}", "name", "c_name")
view("window", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from {orders}", "order/{o_orderkey}", "rank", "r")
view("setops", "select c_nationkey as k from {customer} except select s_nationkey from {supplier} where s_acctbal > 5000", "nation/{k}", "key", "k")
view("intersect", "select c_nationkey as k from {customer} intersect select s_nationkey from {supplier}", "nation/{k}", "key", "k")
view("rollup", "select coalesce(o_orderstatus, 'all') as st, coalesce(o_orderpriority, 'all') as pr, count(*) as n from {orders} group by rollup (o_orderstatus, o_orderpriority)", "status/{st}", "count", "n")
view("cube", "select coalesce(l_returnflag, 'all') as rf, count(*) as n from {lineitem} group by cube (l_returnflag, l_linestatus)", "flag/{rf}", "count", "n")
view("topk", "select c_custkey, c_name from {customer} order by c_acctbal desc, c_custkey limit 20", "customer/{c_custkey}", "name", "c_name")
view("outer_join", "select c_custkey, count(o_orderkey) as n from {customer} c left join {orders} o on c.c_custkey = o.o_custkey group by c_custkey", "customer/{c_custkey}", "orders", "n")
view("semi_join", "select c_custkey, c_name from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey)", "customer/{c_custkey}", "name", "c_name")
view("anti_join", "select p_partkey, p_name from {part} where p_partkey not in (select l_partkey from {lineitem} where l_quantity > 45)", "part/{p_partkey}", "name", "p_name")
view("range_join", "select p.p_partkey, count(*) as n from {part} p join {nation} n on p.p_size >= n.n_nationkey and p.p_size < n.n_nationkey + 3 group by p.p_partkey", "part/{p_partkey}", "n", "n")
view("having", "select l_suppkey, count(*) as n from {lineitem} group by l_suppkey having count(*) > 5", "supplier/{l_suppkey}", "n", "n")
view("subquery", "select o_orderkey, o_orderstatus from {orders} where o_totalprice > (select avg(o_totalprice) from {orders})", "order/{o_orderkey}", "status", "o_orderstatus")
view("three_joins", "select o.o_orderkey as k, r.r_name as r from {orders} o, {customer} c, {nation} n, {region} r where o.o_custkey = c.c_custkey and c.c_nationkey = n.n_nationkey and n.n_regionkey = r.r_regionkey", "order/{k}", "region", "r")
view("concat", "select s_suppkey, s_name || ' / ' || s_nationkey as label from {supplier}", "supplier/{s_suppkey}", "label", "label")
view("json", "select event_id, json_extract_string(props, '$.k') as k from {events}", "event/{event_id}", "k", "k")
view("unnest", "select p_partkey, unnest(string_split(p_type, ' ')) as w from {part}", "part/{p_partkey}", "word", "w")
view("strftime", "select o_orderkey, strftime(o_orderdate, '%d/%m/%Y at %H:%M') as d from {orders}", "order/{o_orderkey}", "date", "d")
view("lists", "select p_partkey, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), '.') as w from {part} where list_contains(string_split(p_type, ' '), 'STEEL') or starts_with(p_brand, 'Brand#1')", "part/{p_partkey}", "words", "w")
view("lambda", "select o_orderkey, array_to_string(list_transform(list_filter(string_split(o_orderpriority, '-'), lambda x: length(x) > 1), lambda x: upper(x)), '+') as w from {orders}", "order/{o_orderkey}", "words", "w")
view("regexp", "select o_orderkey, array_to_string(string_split_regex(o_orderpriority, '[0-9]-'), '>') as p from {orders} where regexp_matches(o_orderpriority, '^[12]')", "order/{o_orderkey}", "priority", "p")
view("small_numbers", "select p_partkey, p_retailprice / 3e6 as x from {part}", "part/{p_partkey}", "x", "x")
view("quoted_names", 'select "c_custkey" as "the key", "c_name" from {customer}', "customer/{the key}", "name", "c_name")
Q["view_quoted_names"].sql = select(CUSTOMER, "name", lit("c_name"), "customer")

# --- other mapping languages
Y_PREFIX = f"prefixes:\n  ex: {EX}\n  grel: \"{GREL}\"\n"


def yarrrml(name: str, body: str, sql: str, quads: bool = False) -> None:
    Q["yarrrml_" + name] = Query(Y_PREFIX + body, sql, quads)


yarrrml("basic", """mappings:
  nation:
    sources: [["{sf}/nation.parquet~parquet"]]
    s: ex:nation/$(n_nationkey)
    po:
      - [a, ex:Nation]
      - [ex:name, $(n_name), en~lang]
      - [ex:key, $(n_nationkey), xsd:integer]
""", union(select(iri("nation/", "n_nationkey"), TYPE, f"'<{EX}Nation>'", "nation"), select(iri("nation/", "n_nationkey"), "name", lit("n_name", "'@en'"), "nation"), select(iri("nation/", "n_nationkey"), "key", typed("n_nationkey", "integer"), "nation")))  # fmt: skip
yarrrml("join", """sources:
  n: {access: "{sf}/nation.parquet"}
  s: {access: "{sf}/supplier.parquet"}
mappings:
  nation:
    sources: n
    subjects: ex:nation/$(n_nationkey)
  supplier:
    sources: s
    subjects: ex:supplier/$(s_suppkey)
    predicateobjects:
      - predicates: ex:nation
        objects:
          - mapping: nation
            condition:
              function: equal
              parameters:
                - [str1, $(s_nationkey)]
                - [str2, $(n_nationkey)]
""", select(SUPP, "nation", iri("nation/", "n_nationkey"), "supplier join nation on s_nationkey = n_nationkey"))  # fmt: skip
yarrrml("condition", """mappings:
  order:
    sources: [["{sf}/orders.parquet"]]
    s: ex:order/$(o_orderkey)
    po:
      - p: ex:urgent
        o:
          value: $(o_custkey)
          condition:
            function: grel:string_startsWith
            parameters:
              - [grel:valueParameter, $(o_orderpriority)]
              - [grel:string_sub, "1-"]
""", select(ORDER, "urgent", lit("o_custkey"), "orders where starts_with(o_orderpriority, '1-')"))  # fmt: skip
yarrrml("inverse", """mappings:
  nation:
    sources: [["{sf}/nation.parquet"]]
    s: ex:nation/$(n_nationkey)
    po:
      - p: ex:in
        i: ex:has
        o: ex:region/$(n_regionkey)~iri
""", union(select(iri("nation/", "n_nationkey"), "in", iri("region/", "n_regionkey"), "nation"), select(iri("region/", "n_regionkey"), "has", iri("nation/", "n_nationkey"), "nation")))  # fmt: skip
yarrrml("function", """mappings:
  part:
    sources: [["{sf}/part.parquet"]]
    s: ex:part/$(p_partkey)
    po:
      - p: ex:name
        o:
          f: grel:toUpperCase(valueParameter = $(p_name))
          type: literal
""", select(PART, "name", lit("upper(p_name)"), "part"))  # fmt: skip
yarrrml("graphs_lists", """mappings:
  part:
    sources: [["{sf}/part.parquet"]]
    s: [ex:part/$(p_partkey), ex:thing/$(p_partkey)]
    g: ex:parts
    po:
      - [[ex:name, ex:label], [$(p_name), $(p_brand)]]
""", union(*(select(iri(f"{s}/", "p_partkey"), p, lit(c), "part", f"'<{EX}parts>'") for s in ("part", "thing") for p in ("name", "label") for c in ("p_name", "p_brand"))), True)  # fmt: skip
yarrrml("quoted", """mappings:
  name:
    sources: [["{sf}/supplier.parquet"]]
    s: ex:supplier/$(s_suppkey)
    po:
      - [ex:name, $(s_name)]
  about:
    sources: [["{sf}/supplier.parquet"]]
    s: {quotedNonAsserted: name}
    po:
      - [ex:nation, $(s_nationkey)]
""", select(quote(SUPP, "name", lit("s_name")), "nation", lit("s_nationkey"), "supplier"))  # fmt: skip
Q["r2rml_basic"] = Query(HEAD + f"""<#R> rr:logicalTable [ rr:tableName "\\"loom_region\\"" ] ; rr:subjectMap [ rr:template "{EX}region/{{\\"r_regionkey\\"}}" ; rr:class ex:Region ] ;
  rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "\\"r_name\\"" ] ] ; rr:predicateObjectMap [ rr:predicate ex:key ; rr:objectMap [ rr:column "r_regionkey" ] ] .""",
    union(select(iri("region/", "r_regionkey"), TYPE, f"'<{EX}Region>'", "region"), select(iri("region/", "r_regionkey"), "name", lit("r_name"), "region"), select(iri("region/", "r_regionkey"), "key", typed("r_regionkey", "integer"), "region")),
    options={"infer_sql_datatypes": True}, prepare=lambda spark, d: spark.read.parquet(f"{d}/region.parquet").createOrReplaceTempView("loom_region") or "")
Q["r2rml_query"] = Query(HEAD + f"""<#R> rr:logicalTable [ rr:sqlQuery "select n_nationkey, n_name from loom_nation where n_regionkey = 1" ] ; rr:subject ex:all ; rr:predicateObjectMap [ rr:predicate ex:has ; rr:objectMap [ rr:template "{EX}nation/{{n_nationkey}}" ] ] .""",
    f"select distinct '<{EX}all>' as s, '<{EX}has>' as p, {iri('nation/', 'n_nationkey')} as o from nation where n_regionkey = 1", prepare=lambda spark, d: spark.read.parquet(f"{d}/nation.parquet").createOrReplaceTempView("loom_nation") or "")
Q["legacy_rml"] = Query(HEAD + f"""<#R> old:logicalSource [ old:source "{{sf}}/region.parquet" ; old:referenceFormulation ql:CSV ] ; rr:subjectMap [ rr:template "{EX}region/{{r_regionkey}}" ] ;
  rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ old:reference "r_name" ; rr:language "en" ] ] .""", select(iri("region/", "r_regionkey"), "name", lit("r_name", "'@en'"), "region"))  # fmt: skip
Q["legacy_fnml"] = Query(HEAD + f"""<#R> old:logicalSource [ old:source "{{sf}}/region.parquet" ] ; rr:subjectMap [ rr:template "{EX}region/{{r_regionkey}}" ] ;
  rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ fnml:functionValue [ rr:predicateObjectMap [ rr:predicate fno:executes ; rr:object grel:toLowerCase ] , [ rr:predicate grel:valueParameter ; rr:objectMap [ old:reference "r_name" ] ] ] ] ] .""", select(iri("region/", "r_regionkey"), "name", lit("lower(r_name)"), "region"))  # fmt: skip

FLAGSHIP = HEAD + MULTI + tm("R", "region", t("region/{r_regionkey}"), pom("name", ref("r_name"))) + tm("N", "nation", t("nation/{n_nationkey}") + " ; rml:class ex:Nation", pom("name", ref("n_name")), pom("inRegion", join("R", ("n_regionkey", "r_regionkey"))))
Q["flagship"] = Query(FLAGSHIP, union(MULTI_SQL, select(iri("region/", "r_regionkey"), "name", lit("r_name"), "region"), select(iri("nation/", "n_nationkey"), TYPE, f"'<{EX}Nation>'", "nation"), select(iri("nation/", "n_nationkey"), "name", lit("n_name"), "nation"), select(iri("nation/", "n_nationkey"), "inRegion", iri("region/", "r_regionkey"), "nation join region on n_regionkey = r_regionkey")))


# --- direct mapping
class Direct(Query):
    """The direct mapping of views whose keys are declared here, as Parquet has none."""

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in ("region", "nation", "supplier"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"loom_{name}")
        foreign = {"loom_nation": [ForeignKey(("n_regionkey",), "loom_region", ("r_regionkey",))], "loom_supplier": [ForeignKey(("s_nationkey",), "loom_nation", ("n_nationkey",))]}
        tables = catalog_schema(spark, {"loom_region": ("r_regionkey",), "loom_nation": ("n_nationkey",), "loom_supplier": ("s_suppkey",)}, foreign)
        return Engine(spark, mapping=direct_mapping(tables, EX), infer_sql_datatypes=True).triples()


def _direct_sql(table: str, key: str, columns: dict[str, str | None], foreign: tuple[str, str, str] | None) -> str:
    s = iri(f"loom_{table}/{key}=", key)
    parts = [select(s, TYPE, f"'<{EX}loom_{table}>'", table)] + [select(s, f"loom_{table}#{c}", typed(c, kind) if kind else lit(c), table) for c, kind in columns.items()]
    if foreign:
        c, parent, k = foreign
        parts.append(select(s, f"loom_{table}#ref-{c}", iri(f"loom_{parent}/{k}=", k), f"{table} join {parent} on {c} = {k}"))
    return union(*parts)


Q["direct_mapping"] = Direct("", union(_direct_sql("region", "r_regionkey", {"r_regionkey": "integer", "r_name": None}, None), _direct_sql("nation", "n_nationkey", {"n_nationkey": "integer", "n_name": None, "n_regionkey": "integer"}, ("n_regionkey", "region", "r_regionkey")), _direct_sql("supplier", "s_suppkey", {"s_suppkey": "integer", "s_name": None, "s_nationkey": "integer", "s_acctbal": "double"}, ("s_nationkey", "nation", "n_nationkey"))))

# --- sinks, read back
sink("folder", lambda engine, path: sinks.write_folder(engine, path))
sink("file", lambda engine, path: sinks.write_file(engine, path))
sink("groups", lambda engine, path: sinks.write_groups(engine, path))
