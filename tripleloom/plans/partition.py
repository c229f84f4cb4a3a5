"""Mapping partitioning: groups of rules of which no two can yield the same statement, so that duplicates are only removed within a group.

Two term maps are apart when their kinds of term differ, or when neither's invariant (the constant text every term begins with) is a
prefix of the other's; two constants are apart when they differ. Partial partitioning cuts by each position by itself;
maximal partitioning cuts within the groups found so far, in the order of positions that gives most groups.
"""

from __future__ import annotations

from itertools import permutations

from ..mapping.rules import Rule, TermMap

POLICIES = ("PARTIAL-AGGREGATIONS", "MAXIMAL", "NO")
NONE = ("NO", "FALSE", "OFF", "0")


def resolve(m: TermMap | None, rules: dict[str, Rule]) -> TermMap | None:
    """A referencing object map stands for its parent's subject map."""
    if m is not None and m.kind == "parent":
        for r in rules.values():
            if r.triples_map == m.value:
                return TermMap(r.subject.kind, r.subject.value, m.termtype or r.subject.termtype, r.subject.call)
    return m


def _family(m: TermMap) -> str:
    """Terms of different families are never equal."""
    if m.termtype == "Literal":
        if m.lang:
            return "lang " + (m.lang.value if m.lang.kind == "constant" else "*")
        if m.datatype:
            return "type " + (m.datatype.value if m.datatype.kind == "constant" else "*")
        return "plain"
    return m.termtype or "IRI"


def cut(rules: list[Rule], position: str, all_: dict[str, Rule]) -> dict[str, str]:
    """A label for each rule id, by one position."""
    maps = {r.id: resolve(getattr(r, position), all_) for r in rules}
    families: dict[str, list[str]] = {}
    loose = {_family(m).split()[0] for m in maps.values() if m and _family(m).endswith("*")}
    for rid, m in maps.items():
        f = _family(m) if m else ""
        families.setdefault(f.split()[0] if f.split()[:1] and f.split()[0] in loose else f, []).append(rid)
    out: dict[str, str] = {}
    for n, (family, ids) in enumerate(sorted(families.items())):
        if family in ("BlankNode", "Triple", ""):
            out |= dict.fromkeys(ids, f"{n}.0")
            continue
        fixed = all(maps[i].kind == "constant" for i in ids)
        number, last = -1, None
        for i in sorted(ids, key=lambda i: (maps[i].invariant, i)):
            own = maps[i].invariant
            # Sorted, texts that share a prefix follow it directly.
            if last is None or (own != last if fixed else not own.startswith(last)):
                number, last = number + 1, own
            out[i] = f"{n}.{number}"
    return out


POSITIONS = ("subject", "predicate", "object", "graph")


def partition(rules: list[Rule], policy: str = POLICIES[0], all_rules: list[Rule] | None = None) -> list[list[Rule]]:
    """The groups, each rule labelled with its group's name."""
    all_ = {r.id: r for r in all_rules or rules}
    if policy == "NO":
        return [[r.with_(group="1") for r in rules]] if rules else []
    if policy == "MAXIMAL":
        best: list[list[Rule]] = []
        for order in permutations(POSITIONS):
            groups = [list(rules)]
            for p in order:
                finer = []
                for g in groups:
                    labels = cut(g, p, all_)
                    by: dict[str, list[Rule]] = {}
                    for r in g:
                        by.setdefault(labels[r.id], []).append(r)
                    finer += by.values()
                groups = finer
            if len(groups) > len(best):
                best = groups
        return [[r.with_(group=str(k + 1)) for r in g] for k, g in enumerate(best)] if rules else []
    labels = [cut(rules, p, all_) for p in POSITIONS]
    by = {}
    for r in rules:
        by.setdefault("-".join(x[r.id] for x in labels), []).append(r)
    return [[r.with_(group=name) for r in g] for name, g in sorted(by.items())]
