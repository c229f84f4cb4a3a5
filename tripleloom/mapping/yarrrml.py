"""YARRRML documents to mapping triples.

A mapping with several sources, subjects, predicates, objects or graphs needs no splitting here: the triples may repeat a property, and
rules are their cross product. Only several sources make several triples maps, as a map has one source.
"""

from __future__ import annotations

import re

import yaml

from ..rdf import BNode, IRI, Literal, Term, Triple
from ..vocab import IDLAB, PREFIXES, RDF_TYPE, RML, SD

KEYS = {
    "mapping": "mappings", "m": "mappings", "subject": "subjects", "s": "subjects", "predicateobject": "predicateobjects", "po": "predicateobjects", "predicate": "predicates", "p": "predicates",
    "inversepredicate": "inversepredicates", "i": "inversepredicates", "object": "objects", "o": "objects", "graph": "graphs", "g": "graphs", "source": "sources", "fn": "function", "f": "function",
    "pms": "parameters", "pm": "parameter", "v": "value", "author": "authors", "a": "authors",
}
REFERENCE = re.compile(r"\$\(((?:[^()\\]|\\.|\([^()]*\))+)\)")
TYPES = {"iri": "IRI", "literal": "Literal", "blanknode": "BlankNode"}
FORMULATIONS = {"csv": "CSV", "jsonpath": "JSONPath", "xpath": "XPath", "sql2008": "SQL2008", "cypher": "Cypher", "geoparquet": "GeoParquet", "shapefile": "Shapefile"}


class Loader(yaml.SafeLoader):
    """Plain scalars stay text: a key ``y`` or a value ``on`` is no boolean."""


Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t in ("tag:yaml.org,2002:null", "tag:yaml.org,2002:merge")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


class YarrrmlError(ValueError):
    pass


def _keys(x, inner: bool = False):
    """Long key names. Below ``mappings``, ``sources``, ``prefixes`` and ``external`` the keys are names of the document's own."""
    if isinstance(x, dict):
        return {k if inner else KEYS.get(k, k): _keys(v, not inner and KEYS.get(k, k) in ("mappings", "prefixes", "external") or not inner and KEYS.get(k, k) == "sources" and isinstance(v, dict) and "access" not in v) for k, v in x.items()}
    return [_keys(v) for v in x] if isinstance(x, list) else x


def _list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


class Document:
    def __init__(self, text: str):
        doc = _keys(yaml.load(text, Loader) or {})
        self.prefixes = PREFIXES | (doc.pop("prefixes", None) or {})
        external = doc.pop("external", None) or {}
        self.doc = self.replace(doc, {f"$(_{k})": str(v) for k, v in external.items()})
        self.out: list[Triple] = []
        self.n = 0
        self.names: dict[str, list[str]] = {}
        self.maps = self.doc.get("mappings") or {}

    def replace(self, x, external: dict[str, str]):
        if isinstance(x, dict):
            return {k: self.replace(v, external) for k, v in x.items()}
        if isinstance(x, list):
            return [self.replace(v, external) for v in x]
        if isinstance(x, str):
            for k, v in external.items():
                x = x.replace(k, v)
            x = x.replace("$(\\_", "$(_")
        return x

    def expand(self, text: str) -> str:
        prefix, colon, rest = text.partition(":")
        return self.prefixes[prefix] + rest if colon and prefix in self.prefixes and not rest.startswith("//") else text

    def node(self) -> BNode:
        self.n += 1
        return BNode(f"y{self.n}")

    def add(self, s: Term, p: str, o: Term) -> None:
        self.out.append((s, IRI(p if ":" in p else RML + p), o))

    def value(self, node: Term, text, iri: bool = True) -> None:
        """A template, reference or constant."""
        text = self.expand(str(text))
        if whole := REFERENCE.fullmatch(text):
            self.add(node, "reference", Literal(whole[1].replace("\\", "")))
        elif REFERENCE.search(text):
            out, last = "", 0
            for m in REFERENCE.finditer(text):
                out += text[last : m.start()].replace("{", "\\{").replace("}", "\\}") + "{" + m[1].replace("\\", "") + "}"
                last = m.end()
            self.add(node, "template", Literal(out + text[last:].replace("{", "\\{").replace("}", "\\}")))
        else:
            self.add(node, "constant", IRI(text) if iri and re.match(r"(https?|ftp|urn|mailto):", text) else Literal(text))

    def function(self, node: Term, spec: dict) -> None:
        name, parameters = spec["function"], spec.get("parameters", [])
        if inline := re.fullmatch(r"\s*([^()\s]+)\s*\((.*)\)\s*", name, re.S):
            name, parameters = inline[1], []
            for part in self.split(inline[2]):
                k, _, v = part.partition("=")
                k, v = k.strip(), v.strip()
                if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
                    v = v[1:-1]
                if ":" not in k and ":" in name and not k.startswith("http"):
                    k = self.expand(name[: name.rindex(":") + 1]) + k if not name.startswith("http") else name[: max(name.rfind("#"), name.rfind("/")) + 1] + k
                parameters.append([k, v])
        execution, fm = self.node(), self.node()
        self.add(node, "functionExecution", execution)
        self.add(execution, "functionMap", fm)
        self.add(fm, "constant", IRI(self.expand(name)))
        for p in _list(parameters) if not isinstance(parameters, dict) else [{"parameter": k, "value": v} for k, v in parameters.items()]:
            k, v = (p[0], p[1]) if isinstance(p, list) else (p["parameter"], p["value"])
            for own in _list(v):
                inp, pm, vm = self.node(), self.node(), self.node()
                self.add(execution, "input", inp)
                self.add(inp, "parameterMap", pm)
                self.add(inp, "inputValueMap", vm)
                self.add(pm, "constant", IRI(self.expand(str(k))))
                if isinstance(own, dict) and "function" in own:
                    self.function(vm, own)
                elif isinstance(own, dict):
                    self.value(vm, own["value"])
                else:
                    self.value(vm, own)

    @staticmethod
    def split(text: str) -> list[str]:
        out, own, quote, depth = [], "", "", 0
        for c in text:
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "()":
                depth += 1 if c == "(" else -1
            if c == "," and not quote and not depth:
                out.append(own)
                own = ""
            else:
                own += c
        return [x for x in [*out, own] if x.strip()]

    def join(self, node: Term, condition) -> None:
        for c in _list(condition):
            pairs = {str(p[0] if isinstance(p, list) else p["parameter"]): str(p[1] if isinstance(p, list) else p["value"]) for p in c.get("parameters", [])}
            side = {k: next((v for n, v in pairs.items() if n.endswith(k)), None) for k in ("str1", "str2")}
            if None in side.values():
                raise YarrrmlError(f"a join condition needs str1 and str2: {c}")
            own = self.node()
            self.add(node, "joinCondition", own)
            for k, name in (("str1", "child"), ("str2", "parent")):
                whole = REFERENCE.fullmatch(side[k])
                self.add(own, name, Literal(whole[1].replace("\\", "") if whole else side[k]))

    def term(self, holder: Term, property: str, spec) -> None:
        """A term map from text, with ``~iri`` and the like, or a dictionary."""
        if isinstance(spec, str):
            m = re.fullmatch(r"(.*)~(iri|literal|blanknode|[\w-]+~lang|lang)", spec, re.S)
            spec = {"value": m[1], "type": m[2]} if m and m[2] in TYPES else {"value": spec}
        node = self.node()
        if "condition" in spec and not self.is_join(spec["condition"]):
            condition = spec["condition"][0] if isinstance(spec["condition"], list) else spec["condition"]
            inner = {"function": spec["function"], "parameters": spec.get("parameters", [])} if "function" in spec else spec["value"]
            spec = {k: v for k, v in spec.items() if k not in ("condition", "value", "function", "parameters")} | {"function": IDLAB + "trueCondition", "parameters": [[IDLAB + "str", inner], [IDLAB + "strBoolean", condition]]}
            spec.setdefault("type", "literal")
        if "mappings" in spec:
            for name in self.names_of(spec["mappings"])[:1]:
                self.add(holder, property, node)
                self.add(node, "parentTriplesMap", IRI(name))
                self.join(node, spec.get("condition"))
        elif "quoted" in spec or "quotedNonAsserted" in spec:
            for name in self.names_of(spec.get("quoted") or spec["quotedNonAsserted"]):
                node = self.node()
                self.add(holder, property, node)
                self.add(node, "quotedTriplesMap", IRI(name))
                self.join(node, spec.get("condition"))
                if "quotedNonAsserted" in spec:
                    self.add(IRI(name), RDF_TYPE, IRI(RML + "NonAssertedTriplesMap"))
            return
        else:
            self.add(holder, property, node)
            if "function" in spec:
                self.function(node, spec)
            else:
                self.value(node, spec["value"], iri=not spec.get("datatype") and not spec.get("language") and spec.get("type") != "literal")
        if "language" in spec:
            m = self.node()
            self.add(node, "languageMap", m)
            self.value(m, re.sub(r"~lang$", "", str(spec["language"])), iri=False)
        elif "datatype" in spec:
            m = self.node()
            self.add(node, "datatypeMap", m)
            self.value(m, spec["datatype"])
        elif "type" in spec:
            if spec["type"] not in TYPES:
                raise YarrrmlError(f"unknown term type {spec['type']!r}")
            self.add(node, "termType", IRI(RML + TYPES[spec["type"]]))

    @staticmethod
    def is_join(condition) -> bool:
        return all(c.get("function", "").rpartition(":")[2].rpartition("#")[2].rpartition("/")[2] == "equal" for c in _list(condition))

    def names_of(self, mapping: str) -> list[str]:
        if mapping not in self.names:
            raise YarrrmlError(f"unknown mapping {mapping!r}")
        return self.names[mapping]

    def source(self, tm: Term, spec) -> None:
        if isinstance(spec, list):
            access, _, formulation = str(spec[0]).partition("~")
            spec = {"access": access} | ({"referenceFormulation": formulation} if formulation else {}) | ({"iterator": spec[1]} if len(spec) > 1 else {})
        node = self.node()
        self.add(tm, "logicalSource", node)
        if "query" in spec:
            self.add(node, "query", Literal(str(spec["query"])))
        elif "table" in spec or "tableName" in spec:
            self.add(node, "tableName", Literal(str(spec.get("table") or spec["tableName"])))
        else:
            access = str(spec["access"])
            named = re.fullmatch(r"\$\((.+)\)", access)
            if named:
                inner = self.node()
                self.add(inner, SD + "name", Literal(named[1]))
                self.add(node, "source", inner)
            else:
                self.add(node, "source", Literal(access))
        if "iterator" in spec:
            self.add(node, "iterator", Literal(str(spec["iterator"])))
        if "referenceFormulation" in spec or "queryFormulation" in spec:
            name = str(spec.get("referenceFormulation") or spec["queryFormulation"])
            self.add(node, "referenceFormulation", IRI(RML + FORMULATIONS.get(name.lower(), name)))

    def load(self) -> list[Triple]:
        shared = {k: v for k, v in (self.doc.get("sources") or {}).items()}
        sources: dict[str, list] = {}
        for name, m in self.maps.items():
            own = m.get("sources")
            own = [own] if isinstance(own, (str, dict)) or isinstance(own, list) and own and all(isinstance(x, str) for x in own) and "~" in own[0] else _list(own)
            found = []
            for s in own:
                if isinstance(s, str):
                    s = shared.get(s, [s])
                elif isinstance(s, list) and len(s) == 1 and s[0] in shared:
                    s = shared[s[0]]
                found.append(s)
            sources[name] = found or [None]
            self.names[name] = [name if len(sources[name]) == 1 else f"{name}_{k}" for k in range(len(sources[name]))]
        for name, m in self.maps.items():
            for tm, spec in zip(self.names[name], sources[name]):
                self.triples_map(IRI(tm), m, spec)
        return self.out

    def triples_map(self, tm: IRI, m: dict, source) -> None:
        if source is not None:
            self.source(tm, source)
        subjects = _list(m.get("subjects"))
        inverse: list[tuple] = []
        poms = [self.pom(po) for po in _list(m.get("predicateobjects"))] if not self.is_short(m.get("predicateobjects")) else [self.pom(m["predicateobjects"])]
        for po in poms:
            for p in _list(po.get("inversepredicates")):
                inverse.append((p, po["objects"]))
        if not subjects:
            node = self.node()
            self.add(tm, "subjectMap", node)
            self.add(node, "constant", BNode(f"{self.node()}"))
            self.add(node, "termType", IRI(RML + "BlankNode"))
        for s in subjects:
            self.term(tm, "subjectMap", s)
        for po in poms:
            if "predicates" not in po:
                continue
            node = self.node()
            self.add(tm, "predicateObjectMap", node)
            for p in _list(po["predicates"]):
                self.term(node, "predicateMap", RDF_TYPE if p == "a" else p)
            for o in po["objects"]:
                self.term(node, "objectMap", self.iri_if_type(o, po["predicates"]))
            for g in _list(po.get("graphs")) + _list(m.get("graphs")):
                self.term(node, "graphMap", g)
        for k, (p, objects) in enumerate(inverse):
            for j, o in enumerate(objects):
                other = IRI(f"{tm}_inverse{k}_{j}")
                if source is not None:
                    self.source(other, source)
                self.term(other, "subjectMap", o if isinstance(o, str) else {k: v for k, v in o.items() if k not in ("datatype", "language")})
                node = self.node()
                self.add(other, "predicateObjectMap", node)
                self.term(node, "predicateMap", p)
                for s in subjects:
                    self.term(node, "objectMap", {"value": s, "type": "iri"} if isinstance(s, str) and "~" not in s else s)
                for g in _list(m.get("graphs")):
                    self.term(node, "graphMap", g)

    def iri_if_type(self, o, predicates):
        """Objects of rdf:type are resources."""
        if isinstance(o, dict) and set(o) == {"value"} and any(self.expand(str(p)) in ("a", RDF_TYPE) for p in _list(predicates)):
            return o | {"type": "iri"}
        return o

    @staticmethod
    def is_short(po) -> bool:
        """A single [predicate, object] in place of a list of them."""
        return isinstance(po, list) and len(po) in (2, 3) and isinstance(po[0], str) and isinstance(po[1], str)

    def pom(self, po) -> dict:
        if isinstance(po, list):
            objects = _list(po[1])
            extra = {}
            if len(po) > 2:
                extra = {"language": po[2][:-5]} if str(po[2]).endswith("~lang") else {"datatype": po[2]}
            return {"predicates": po[0], "objects": [self.object(o, extra) for o in objects]}
        extra = {k: po[k] for k in ("type", "datatype", "language") if k in po}
        objects = po.get("objects")
        if isinstance(objects, dict):
            objects = [objects]
        out = dict(po, objects=[self.object(o, extra) for o in _list(objects)])
        if "condition" in po:
            out["objects"] = [o | {"condition": po["condition"]} for o in out["objects"]]
        return out

    @staticmethod
    def object(o, extra: dict) -> dict:
        if isinstance(o, list):
            value, kind = (o + [None])[:2]
            more = {} if kind is None else {"language": kind[:-5]} if str(kind).endswith("~lang") else {"datatype": kind}
            o = {"value": value} | more
        elif not isinstance(o, dict):
            m = re.fullmatch(r"(.*)~(iri|literal|blanknode)", str(o), re.S)
            o = {"value": m[1], "type": m[2]} if m else {"value": o}
        return extra | o


def load_yarrrml(text: str) -> list[Triple]:
    return Document(text).load()
