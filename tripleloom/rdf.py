"""A small RDF model for mapping documents: Turtle, N-Triples and N-Quads reading, N-Triples writing, isomorphism for tests."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from typing import NamedTuple
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


class IRI(str):
    __slots__ = ()

    def __repr__(self) -> str:
        return f"<{self}>"


class BNode(str):
    __slots__ = ()

    def __repr__(self) -> str:
        return f"_:{self}"


class Literal(NamedTuple):
    value: str
    lang: str | None = None
    datatype: str | None = None


Term = IRI | BNode | Literal
Triple = tuple[Term, Term, Term]

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<iri><[^<>\s]*>)
  | (?P<directive>@prefix|@base|(?i:PREFIX|BASE)(?=\s+[<\w:]))
  | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  | (?P<type>\^\^)
  | (?P<bnode>_:[\w][\w.\-]*(?<!\.))
  | (?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<name>(?:[^\W\d_][\w.\-]*(?<!\.))?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>a(?=[\s<\[])|true\b|false\b)
  | (?P<mark>[.;,\[\]()])""",
    re.X,
)
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


class RDFError(ValueError):
    pass


def unescape(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text)


class Turtle:
    """Parses Turtle, of which N-Triples is a part."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.tokens, self.at = [], 0
        k = 0
        while k < len(text):
            m = TOKEN.match(text, k)
            if not m:
                raise RDFError(f"can't read Turtle at {text[k : k + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            k = m.end()
        self.base, self.prefixes, self.scope, self.count = base, {}, scope, itertools.count()
        self.triples: list[Triple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def expect(self, mark: str) -> None:
        if (t := self.next())[1] != mark:
            raise RDFError(f"expected {mark!r}, found {t[1]!r}")

    def fresh(self) -> BNode:
        return BNode(f"{self.scope}b{next(self.count)}")

    def parse(self) -> list[Triple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive":
                self.directive()
                continue
            if text == "[":
                subject = self.blank()
                if self.peek()[1] != ".":
                    self.properties(subject)
            else:
                self.properties(self.term())
            self.expect(".")
        return self.triples

    def directive(self) -> None:
        _, word = self.next()
        if word.lstrip("@").lower() == "prefix":
            name = self.next()[1]
            if not name.endswith(":"):
                raise RDFError(f"bad prefix {name!r}")
            self.prefixes[name[:-1]] = self.iri(self.next()[1])
        else:
            self.base = self.iri(self.next()[1])
        if word.startswith("@"):
            self.expect(".")

    def iri(self, text: str) -> IRI:
        if not text.startswith("<"):
            raise RDFError(f"expected an IRI, found {text!r}")
        own = unescape(text[1:-1])
        return IRI(own if re.match(r"[A-Za-z][\w+.\-]*:", own) or not self.base else urljoin(self.base, own))

    def properties(self, subject: Term) -> None:
        while True:
            kind, text = self.peek()
            predicate = IRI(RDF + "type") if (kind, text) == ("word", "a") else None
            if predicate:
                self.next()
            else:
                predicate = self.term()
            while True:
                self.triples.append((subject, predicate, self.term()))
                if self.peek()[1] != ",":
                    break
                self.next()
            while (more := self.peek()[1] == ";") and self.tokens[self.at + 1 : self.at + 2] and self.tokens[self.at + 1][1] == ";":
                self.next()
            if not more:
                return
            self.next()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def blank(self) -> BNode:
        self.expect("[")
        node = self.fresh()
        if self.peek()[1] != "]":
            self.properties(node)
        self.expect("]")
        return node

    def term(self) -> Term:
        kind, text = self.peek()
        if text == "[" and kind == "mark":
            return self.blank()
        self.next()
        if text == "(" and kind == "mark":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.next()
            rest: Term = IRI(RDF + "nil")
            for x in reversed(items):
                node = self.fresh()
                self.triples += [(node, IRI(RDF + "first"), x), (node, IRI(RDF + "rest"), rest)]
                rest = node
            return rest
        if kind == "iri":
            return self.iri(text)
        if kind == "bnode":
            return BNode(f"{self.scope}n_{text[2:]}")
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise RDFError(f"unknown prefix {prefix!r}")
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind in ("string", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            after, more = self.peek()
            if after == "lang":
                self.next()
                return Literal(value, more[1:])
            if after == "type":
                self.next()
                return Literal(value, None, str(self.term()))
            return Literal(value)
        if kind == "number":
            return Literal(text, None, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text != "a":
            return Literal(text, None, XSD + "boolean")
        raise RDFError(f"unexpected {text!r}")


def parse_turtle(text: str, base: str = "", scope: str = "") -> list[Triple]:
    return Turtle(text, base, scope).parse()


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace('"', '\\"')


def to_nt(term: Term) -> str:
    if isinstance(term, Literal):
        return f'"{escape(term.value)}"' + (f"@{term.lang}" if term.lang else f"^^<{term.datatype}>" if term.datatype else "")
    return repr(term)


class Graph:
    """Triples with an index by subject."""

    def __init__(self, triples=()):
        self.triples = list(dict.fromkeys(triples))
        self.by: dict[Term, dict[str, list[Term]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in self.triples:
            self.by[s][str(p)].append(o)

    def objects(self, s: Term, p: str) -> list[Term]:
        return self.by[s][p] if s in self.by and p in self.by[s] else []

    def first(self, s: Term, p: str) -> Term | None:
        return next(iter(self.objects(s, p)), None)


TERM = re.compile(r'<<\s|\s>>|<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?')


def parse_nquads(text: str) -> set[tuple[str, ...]]:
    """Statements as tuples of serialized terms; a quoted triple is one term."""
    out = set()
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        terms, depth, own = [], 0, ""
        for m in TERM.finditer(line):
            t = m[0].strip()
            if t == "<<":
                own, depth = own + "<< ", depth + 1
            elif t == ">>":
                own, depth = own + ">> ", depth - 1
            elif depth:
                own += t + " "
            else:
                terms.append(t)
            if own and not depth:
                terms.append(own.strip())
                own = ""
        out.add(tuple(terms))
    return out


def isomorphic(a: set[tuple[str, ...]], b: set[tuple[str, ...]]) -> bool:
    """Equal but for the names of blank nodes."""

    def color(g: set[tuple[str, ...]]) -> dict[str, int]:
        nodes = {t for row in g for t in row if t.startswith("_:")}
        own = dict.fromkeys(nodes, 0)
        for _ in range(len(nodes) + 1):
            new = {n: hash((own[n], tuple(sorted((i, *(x if x not in own else ("@" if x == n else str(own[x])) for x in row)) for row in g for i, t in enumerate(row) if t == n)))) for n in nodes}
            if len(set(new.values())) == len(set(own.values())):
                return new
            own = new
        return own

    if len(a) != len(b):
        return False
    ca, cb = color(a), color(b)
    if sorted(ca.values()) != sorted(cb.values()):
        return False
    classes = defaultdict(lambda: ([], []))
    for n, c in sorted(ca.items()):
        classes[c][0].append(n)
    for n, c in sorted(cb.items()):
        classes[c][1].append(n)

    def search(todo: list, names: dict[str, str]) -> bool:
        if not todo:
            return {tuple(names.get(t, t) for t in row) for row in a} == b
        left, right = todo[0]
        return any(search(todo[1:], names | dict(zip(left, order))) for order in itertools.permutations(right))

    return search(list(classes.values()), {})
