"""The rule representation: one rule per subject x predicate x object x graph over one logical source."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..vocab import DEFAULT_GRAPH


def parse_template(text: str) -> tuple[tuple[str, bool], ...]:
    """Segments (text, is a reference). ``\\{`` and ``\\}`` are braces of the text."""
    out: list[tuple[str, bool]] = []
    own, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "\\" and text[k + 1 : k + 2] in ("{", "}"):
            own, k = own + text[k + 1], k + 2
        elif c == "{" and (end := _closing(text, k)) > k + 1:
            if own:
                out.append((own, False))
            out.append((text[k + 1 : end].replace("\\{", "{").replace("\\}", "}"), True))
            own, k = "", end + 1
        else:
            own, k = own + c, k + 1
    if own or not out:
        out.append((own, False))
    return tuple(out)


def _closing(text: str, k: int) -> int:
    while (k := text.find("}", k + 1)) >= 0:
        if text[k - 1] != "\\":
            return k
    return -1


@dataclass(frozen=True)
class LogicalSource:
    section: str = ""
    kind: str = "source"  # source, tableName or query
    value: str = ""
    iterator: str | None = None
    formulation: str | None = None


@dataclass(frozen=True)
class FnCall:
    function: str
    args: tuple[tuple[str, TermMap], ...] = ()


@dataclass(frozen=True)
class TermMap:
    kind: str  # constant, template, reference, function, quoted or parent
    value: str = ""
    termtype: str | None = None  # IRI, BlankNode, Literal or Triple
    call: FnCall | None = None
    lang: TermMap | None = None
    datatype: TermMap | None = None
    joins: tuple[tuple[str, str], ...] = ()

    @property
    def segments(self) -> tuple[tuple[str, bool], ...]:
        if self.kind == "reference":
            return ((self.value, True),)
        if self.kind == "constant":
            return ((self.value, False),)
        return parse_template(self.value)

    def references(self) -> list[str]:
        """References that the child row must have, in order."""
        out: list[str] = []
        if self.kind in ("template", "reference"):
            out += [t for t, is_ref in self.segments if is_ref]
        elif self.kind == "function":
            for _, a in self.call.args:
                out += a.references()
        out += [c for c, _ in self.joins]
        for m in (self.lang, self.datatype):
            if m:
                out += m.references()
        return list(dict.fromkeys(out))

    @property
    def invariant(self) -> str:
        """What every term begins with."""
        if self.kind == "constant":
            return self.value
        if self.kind == "template":
            text, is_ref = self.segments[0]
            return "" if is_ref else text
        return ""


DEFAULT = TermMap("constant", DEFAULT_GRAPH, "IRI")


@dataclass(frozen=True)
class Rule:
    id: str
    triples_map: str
    source: LogicalSource
    subject: TermMap
    predicate: TermMap | None
    object: TermMap | None
    graph: TermMap = DEFAULT
    asserted: bool = True
    group: str = field(default="", compare=False)

    def with_(self, **changes) -> Rule:
        return replace(self, **changes)

    @property
    def maps(self) -> tuple[TermMap, ...]:
        return tuple(m for m in (self.subject, self.predicate, self.object, self.graph) if m)

    def references(self) -> list[str]:
        return list(dict.fromkeys(r for m in self.maps for r in m.references()))
