"""Mapping graphs to rules: older vocabularies, shortcuts, classes, graphs, term types, functions and quoted triples."""

from __future__ import annotations

from ..rdf import BNode, Graph, IRI, Literal, Term, Triple
from ..vocab import DEFAULT_GRAPH, FNML, FNO, OBJECTS, PREDICATES, RDF_TYPE, RML, RR, SD, SHORTCUTS, XSD
from .rules import DEFAULT, FnCall, LogicalSource, Rule, TermMap, parse_template


class MappingError(ValueError):
    pass


KINDS = ("constant", "template", "reference", "functionExecution", "quotedTriplesMap")
ALLOWED = {"subject": {"IRI", "BlankNode", "Triple"}, "predicate": {"IRI"}, "graph": {"IRI"}, "object": {"IRI", "BlankNode", "Literal", "Triple"}}


def rewrite(triples: list[Triple]) -> Graph:
    """The graph in the current vocabulary, with shortcuts spelled out."""
    sql = {s for s, p, _ in triples if str(p) in (RR + "sqlQuery", RR + "tableName")}
    out: list[Triple] = [(s, IRI(PREDICATES.get(str(p), str(p))), IRI(OBJECTS[o]) if isinstance(o, IRI) and o in OBJECTS else o) for s, p, o in triples]
    out += [(s, IRI(RML + "sqlVersion"), IRI(RML + "SQL2008")) for s in sql]
    long: list[Triple] = []
    for k, (s, p, o) in enumerate(out):
        if str(p) in SHORTCUTS and not (str(p) == RML + "subject" and False):
            node = BNode(f"short{k}")
            long += [(s, IRI(SHORTCUTS[str(p)]), node), (node, IRI(RML + "constant"), o)]
        else:
            long.append((s, p, o))
    return Graph(long)


class Extractor:
    def __init__(self, triples: list[Triple], section: str):
        self.g, self.section, self.n = rewrite(triples), section, 0

    def objects(self, s: Term, name: str) -> list[Term]:
        return self.g.objects(s, RML + name)

    def one(self, s: Term, name: str) -> Term | None:
        return self.g.first(s, RML + name)

    @staticmethod
    def text(term: Term | None) -> str | None:
        return None if term is None else term.value if isinstance(term, Literal) else str(term)

    def triples_maps(self) -> list[Term]:
        named = {s for s, p, _ in self.g.triples if str(p) in (RML + "subjectMap", RML + "logicalSource")}
        return sorted((s for s in named if self.objects(s, "subjectMap")), key=str)

    def source(self, tm: Term) -> LogicalSource:
        node = self.one(tm, "logicalSource")
        if node is None:
            return LogicalSource(self.section)
        kind, value = "source", ""
        for name in ("source", "tableName", "query"):
            for v in self.objects(node, name):
                inner = self.g.first(v, SD + "name") if not isinstance(v, Literal) else None
                kind, value = name, "{" + self.text(inner) + "}" if inner is not None else self.text(v)
        return LogicalSource(self.section, kind, value, self.text(self.one(node, "iterator")), self.text(self.one(node, "referenceFormulation")))

    def call(self, node: Term) -> FnCall:
        fm = self.one(node, "functionMap")
        if fm is None:
            raise MappingError("a function execution has no function")
        args = []
        for inp in self.objects(node, "input"):
            value = self.one(inp, "inputValueMap")
            for pm in self.objects(inp, "parameterMap"):
                if value is not None:
                    args.append((self.text(self.one(pm, "constant")), self.term(value, "argument")))
        return FnCall(self.text(self.one(fm, "constant")), tuple(args))

    def old_call(self, node: Term) -> FnCall:
        """A function given as a triples map of its own: what it executes, and its arguments, are predicate-object maps."""
        function, args = None, []
        for pom in self.objects(node, "predicateObjectMap"):
            for pm in self.objects(pom, "predicateMap"):
                name = self.text(self.one(pm, "constant"))
                for om in self.objects(pom, "objectMap"):
                    if name == FNO + "executes":
                        function = self.text(self.one(om, "constant"))
                    elif name:
                        args.append((name, self.term(om, "argument")))
        if not function:
            raise MappingError("a function value executes nothing")
        return FnCall(function, tuple(sorted(args, key=lambda a: a[0])))

    def joins(self, node: Term) -> tuple[tuple[str, str], ...]:
        pairs = {(self.text(self.one(j, "child")), self.text(self.one(j, "parent"))) for j in self.objects(node, "joinCondition")}
        return tuple(sorted((c, p) for c, p in pairs if c is not None and p is not None))

    def term(self, node: Term, position: str) -> TermMap:
        found = [(k, v) for k in KINDS for v in self.objects(node, k)]
        old = self.g.first(node, FNML + "functionValue")
        parent = self.one(node, "parentTriplesMap")
        given = self.text(self.one(node, "termType"))
        given = {RML + "IRI": "IRI", RML + "BlankNode": "BlankNode", RML + "Literal": "Literal", RML + "RDFstarTriple": "Triple"}.get(given, given)
        language = next((self.term(m, "argument") for m in self.objects(node, "languageMap")), None)
        datatype = next((self.term(m, "argument") for m in self.objects(node, "datatypeMap")), None)
        if datatype and datatype.kind == "constant" and datatype.value == XSD + "string":
            datatype = None
        extra = {"lang": language, "datatype": datatype}
        if parent is not None and not found:
            return TermMap("parent", str(parent), given, joins=self.joins(node))
        if old is not None and not found:
            return TermMap("function", "", given or self._default("function", None, position, extra), self.old_call(old), **extra)
        if len(found) != 1:
            raise MappingError(f"a term map has {len(found)} values where it needs one: {[str(v) for _, v in found]}")
        kind, value = found[0]
        if kind == "functionExecution":
            return TermMap("function", "", given or self._default("function", None, position, extra), self.call(value), **extra)
        if kind == "quotedTriplesMap":
            return TermMap("quoted", str(value), "Triple", joins=self.joins(node))
        if kind == "constant":
            if isinstance(value, BNode):
                return TermMap("constant", str(value), given or "BlankNode", **extra)
            own = self.text(value)
            if isinstance(value, Literal) and position == "object" and not language and not datatype:
                extra = {"lang": TermMap("constant", value.lang) if value.lang else None, "datatype": TermMap("constant", value.datatype) if value.datatype and value.datatype != XSD + "string" else None}
            return TermMap("constant", own, given or self._default("constant", value, position, extra), **extra)
        own = self.text(value)
        if kind == "template" and not any(r for _, r in parse_template(own)) and position != "argument":
            raise MappingError(f"template {own!r} has no reference")
        return TermMap(kind, own, given or self._default(kind, value, position, extra), **extra)

    @staticmethod
    def _default(kind: str, value, position: str, extra: dict) -> str:
        if kind == "constant" and isinstance(value, Literal):
            return "Literal"
        if position == "object" and (kind in ("reference", "function") or extra["lang"] or extra["datatype"]):
            return "Literal"
        return "IRI"

    def rules(self) -> list[Rule]:
        maps = {str(tm): tm for tm in self.triples_maps()}
        out: list[Rule] = []
        subjects = {}
        for name, tm in maps.items():
            own = [self.term(m, "subject") for m in self.objects(tm, "subjectMap")]
            if not own:
                raise MappingError(f"{name} has no subject")
            subjects[name] = own
        for name, tm in maps.items():
            types = {str(t) for t in self.g.objects(tm, RDF_TYPE)}
            src = self.source(tm)
            sm_nodes = self.objects(tm, "subjectMap")
            asserted = RML + "NonAssertedTriplesMap" not in types
            made: list[tuple[TermMap, TermMap, TermMap | None, TermMap]] = []
            for node, subject in zip(sm_nodes, subjects[name]):
                shared = [self.term(m, "graph") for m in self.objects(node, "graphMap")]
                classes = [(TermMap("constant", RDF_TYPE, "IRI"), TermMap("constant", self.text(c), "IRI"), []) for c in self.objects(node, "class")]
                poms = []
                for pom in self.objects(tm, "predicateObjectMap"):
                    graphs = [self.term(m, "graph") for m in self.objects(pom, "graphMap")]
                    for pm in self.objects(pom, "predicateMap"):
                        for om in self.objects(pom, "objectMap"):
                            o = self.term(om, "object")
                            if o.kind == "parent":
                                if o.value not in subjects:
                                    raise MappingError(f"unknown parent triples map {o.value}")
                                o = TermMap("parent", o.value, o.termtype or subjects[o.value][0].termtype, joins=o.joins)
                            poms.append((self.term(pm, "predicate"), o, graphs))
                for p, o, graphs in classes + poms:
                    for g in list(dict.fromkeys(shared + graphs)) or [DEFAULT]:
                        made.append((subject, p, o, g))
                if not classes and not poms:
                    out.append(Rule("", name, src, subject, None, None, DEFAULT, False))
            for subject, p, o, g in made:
                for position, m in (("subject", subject), ("predicate", p), ("object", o), ("graph", g)):
                    if m.termtype not in ALLOWED[position]:
                        raise MappingError(f"term type {m.termtype} isn't allowed for a {position} ({name})")
                out.append(Rule("", name, src, subject, p, o, g, asserted))
        return out


def number(rules: list[Rule]) -> list[Rule]:
    return [r.with_(id=f"#TM{k}") for k, r in enumerate(dict.fromkeys(rules))]


def expand_quoted(rules: list[Rule]) -> list[Rule]:
    """Quoted maps refer to rules, not to triples maps: a copy of the quoting rule for each rule they may stand for, to any depth."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        if r.predicate:
            by.setdefault(r.triples_map, []).append(r)
    out, todo = [], list(rules)
    ids = {r.id for r in rules}
    n = 0
    while todo:
        r = todo.pop(0)
        for position in ("subject", "object"):
            m = getattr(r, position)
            if m and m.kind == "quoted" and m.value not in ids:
                if m.value not in by:
                    raise MappingError(f"unknown quoted triples map {m.value}")
                for q in by[m.value]:
                    todo.append(r.with_(**{position: TermMap("quoted", q.id, "Triple", joins=m.joins)}))
                break
        else:
            out.append(r)
    # A quoted rule that quotes by itself was expanded to several: those that quote it have to be, too.
    variants: dict[str, list[Rule]] = {}
    for r in out:
        variants.setdefault(r.id, []).append(r)
    if all(len(v) == 1 for v in variants.values()):
        return out
    fixed, names = [], {}
    for rid, v in variants.items():
        names[rid] = []
        for r in v:
            new = rid if len(v) == 1 else f"{rid}.{n}"
            n += 1
            names[rid].append(new)
            fixed.append(r.with_(id=new))
    done, todo = [], fixed
    while todo:
        r = todo.pop(0)
        for position in ("subject", "object"):
            m = getattr(r, position)
            if m and m.kind == "quoted" and m.value in names and names[m.value] != [m.value]:
                todo += [r.with_(**{position: TermMap("quoted", q, "Triple", joins=m.joins)}) for q in names[m.value]]
                break
        else:
            done.append(r)
    return done


def drop_self_joins(rules: list[Rule]) -> list[Rule]:
    """Referencing object maps whose parent reads the same rows (same source and iterator, no condition or child = parent throughout) become the parent's subject map."""
    subject: dict[str, tuple[LogicalSource, TermMap]] = {}
    for r in rules:
        subject.setdefault(r.triples_map, (r.source, r.subject))
    out = []
    for r in rules:
        o = r.object
        if o and o.kind == "parent":
            source, own = subject[o.value]
            if (source.kind, source.value, source.iterator, source.section) == (r.source.kind, r.source.value, r.source.iterator, r.source.section) and all(c == p for c, p in o.joins):
                r = r.with_(object=TermMap(own.kind, own.value, o.termtype or own.termtype, own.call, joins=own.joins))
            elif not o.joins:
                raise MappingError(f"{r.triples_map} refers to {o.value}, of another source, without a join condition")
        out.append(r)
    return out


def undelimit(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in '"`' else text


def undelimited(rules: list[Rule]) -> list[Rule]:
    """Names of tables and columns without the double quotes or backticks around them."""

    def fix(m: TermMap | None) -> TermMap | None:
        if m is None:
            return None
        value = m.value
        if m.kind == "reference":
            value = undelimit(value)
        elif m.kind == "template":
            value = "".join("{" + undelimit(t).replace("{", "\\{").replace("}", "\\}") + "}" if ref else t.replace("{", "\\{").replace("}", "\\}") for t, ref in m.segments)
        call = FnCall(m.call.function, tuple((p, fix(a)) for p, a in m.call.args)) if m.call else None
        return TermMap(m.kind, value, m.termtype, call, fix(m.lang), fix(m.datatype), tuple((undelimit(c), undelimit(p)) for c, p in m.joins))

    out = []
    for r in rules:
        s = r.source
        if s.kind == "tableName":
            s = LogicalSource(s.section, s.kind, ".".join(undelimit(x) for x in s.value.split(".")) if s.value[:1] in '"`' else s.value, s.iterator, s.formulation)
        out.append(r.with_(source=s, subject=fix(r.subject), predicate=fix(r.predicate), object=fix(r.object), graph=fix(r.graph)))
    return out


def check_ids(by_section: dict[str, list[Rule]]) -> None:
    seen: dict[str, str] = {}
    for section, rules in by_section.items():
        for tm in {r.triples_map for r in rules}:
            if seen.setdefault(tm, section) != section:
                raise MappingError(f"triples map {tm} occurs in sections {seen[tm]} and {section}")


def to_rules(by_section: dict[str, list[Triple]], self_joins: bool = True) -> list[Rule]:
    """Normalized rules of all sections."""
    own = {section: Extractor(triples, section).rules() for section, triples in by_section.items()}
    check_ids(own)
    rules = undelimited([r for v in own.values() for r in v])
    rules = number(drop_self_joins(rules) if self_joins else rules)
    return expand_quoted(rules)
