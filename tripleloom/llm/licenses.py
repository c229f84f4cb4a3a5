"""License scans by patience alignment.

Text and template are word sequences. Anchors are the words that occur once in each; the longest increasing subsequence of
their positions is kept, runs of equal words grow around each anchor, and the gaps between are aligned the same way; small gaps without such a word by
their longest common subsequence. A text is cut where a template word comes again, and aligned outward from each place of it, so every copy is found. The template words matched
within one dense stretch of the text, over the template's length, are its coverage. The phrases that tell a template from its neighbours must be among them, whatever the coverage.

Only texts that could reach the coverage are aligned: the words a text shares with a template, each as often as the rarer side has it, are an upper bound.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, ready, words
from .license_texts import MUST, TEMPLATES

COVERAGE, GAP = 0.8, 12
SMALL = 600  # cells of a gap's table of common subsequences
WHOLE = 8  # phrases of up to so many words must stand word by word; of longer ones, whole clauses, half the words


def _unique(own: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for k in range(lo, hi):
        seen[own[k]] = -1 if own[k] in seen else k
    return {w: k for w, k in seen.items() if k >= 0}


def _common(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a[a0:a1] and b[b0:b1], its places in a as early as can be."""
    n, m = a1 - a0, b1 - b0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        own, below, x = best[i], best[i + 1], a[a0 + i]
        for j in range(m - 1, -1, -1):
            own[j] = below[j + 1] + 1 if x == b[b0 + j] else max(below[j], own[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m and best[i][j]:
        k = next((k for k in range(j, m) if a[a0 + i] == b[b0 + k] and best[i + 1][k + 1] + 1 == best[i][j]), -1)
        if k >= 0:
            out.append((a0 + i, b0 + k))
            j = k + 1
        i += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched (place in a, place in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_b = _unique(b, b0, b1)
        in_a = _unique(a, a0, a1)
        both = sorted((k, in_b[w]) for w, k in in_a.items() if w in in_b)
        if not both:
            if (a1 - a0) * (b1 - b0) <= SMALL:
                out += _common(a, b, a0, a1, b0, b1)
            continue
        # Patience: the least last element of increasing runs of each length, with back links.
        tops, at, back = [], [], [-1] * len(both)
        for n, (_, y) in enumerate(both):
            p = bisect_left(tops, y)
            back[n] = at[p - 1] if p else -1
            if p == len(tops):
                tops.append(y)
                at.append(n)
            else:
                tops[p], at[p] = y, n
        chain, n = [], at[-1]
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        x0, y0 = a0, b0
        for x, y in reversed(chain):
            todo.append((x0, x, y0, y))
            out.append((x, y))
            x0, y0 = x + 1, y + 1
        todo.append((x0, a1, y0, b1))
    return sorted(out)


def stretches(pairs: list[tuple[int, int]], gap: int = GAP) -> list[list[tuple[int, int]]]:
    """The stretches in which neighbours are at most ``gap`` text words further apart than in the template."""
    out: list[list[tuple[int, int]]] = []
    for p in pairs:
        if not out or (p[0] - out[-1][-1][0]) - (p[1] - out[-1][-1][1]) > gap:
            out.append([])
        out[-1].append(p)
    return out


def densest(pairs: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """The stretch with most matches."""
    return max(stretches(pairs, gap), key=len, default=[])


def _starts(own: list[str], phrase: list[str]) -> list[int]:
    n = len(phrase)
    return [k for k in range(len(own) - n + 1) if own[k] == phrase[0] and own[k : k + n] == phrase]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, must: dict[str, tuple[str, ...]] = MUST):
        self.templates = {k: words(v) for k, v in sorted(templates.items()) if words(v)}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.coverage = coverage
        # A template's phrases: their length and their places in it.
        phrases = {k: [words(x) for x in must.get(k, ())] for k in self.templates}
        self.must = {k: [(len(x), at) for x in own if (at := _starts(self.templates[k], x))] for k, own in phrases.items()}
        # The places of a template from which it's aligned outward: of its phrase that comes least often, or else of all its rare words.
        self.anchors: dict[str, list[tuple[list[str], list[int]]]] = {}
        for k, own in self.must.items():
            short = [(len(at), n, at) for n, at in own if n <= WHOLE]
            if short:
                _, n, at = min(short, key=lambda x: (x[0], -x[1]))
                self.anchors[k] = [(self.templates[k][at[0] : at[0] + n], at)]
        # To reach the coverage a text must hold one of any (1 - coverage) * length + 1 of the words: the longest ones, here, as those are rare.
        self.rare: dict[str, list[str]] = {}
        for k, v in self.templates.items():
            room, own = int((1 - coverage) * len(v) + 1e-9) + 1, []
            for w in sorted(self.counts[k], key=lambda w: (-len(w), w)):
                if room <= 0:
                    break
                own.append(w)
                room -= self.counts[k][w]
            for w in own:
                self.rare.setdefault(w, []).append(k)
            self.anchors.setdefault(k, [([w], _starts(v, [w])) for w in own])

    def places(self, name: str, best: list[tuple[int, int]]) -> set[int] | None:
        """Places in the text of the template's phrases, none if one is missing or something stands between its words."""
        at, out = {y: x for x, y in best}, set()
        for n, starts in self.must[name]:
            for p in starts:
                own = [at[y] for y in range(p, p + n) if y in at]
                if len(own) == n and own[-1] - own[0] == n - 1 or n > WHOLE and 2 * len(own) >= n:
                    out.update(own)
                    break
            else:
                return None
        return out

    def _whole(self, name: str, pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """The stretches that reach the coverage and hold the template's phrases."""
        least = self.coverage * len(self.templates[name])
        return [x for x in stretches(pairs) if len(x) >= least and self.places(name, x) is not None]

    def copies(self, name: str, own: list[str], exact: bytearray, held: bytearray) -> list[list[tuple[int, int]]]:
        """The template's stretches in a text, those with most matches first where they overlap, by place.

        A stretch that reaches the coverage holds an anchor, so the text is aligned outward from each place of each, up to where the anchor belongs to another copy.
        Words in ``exact`` copies of longer templates are theirs, and for a template without phrases those in any copy of one (``held``); what is found is added to both.
        """
        t = self.templates[name]
        found = self._whole(name, align(own, t))
        where: dict[str, list[int]] = {}
        for k, w in enumerate(own):
            where.setdefault(w, []).append(k)
        done = bytearray(exact if self.must[name] else held)

        def mark(x: list[tuple[int, int]], way: bytearray) -> None:
            way[x[0][0] : x[-1][0] + 1] = b"\1" * (x[-1][0] + 1 - x[0][0])

        for x in found:
            if len(x) == len(t) == x[-1][0] + 1 - x[0][0]:
                mark(x, done)
        for phrase, at in self.anchors[name]:
            n = len(phrase)
            starts = [k for k in where.get(phrase[0], ()) if own[k : k + n] == phrase]
            for i, k in enumerate(starts):
                if done[k]:
                    continue
                for j, p in enumerate(at):
                    first = starts[i - j - 1] + n if i > j else 0
                    last = starts[i + len(at) - j] if i + len(at) - j < len(starts) else len(own)
                    for wide in (1, 2):
                        lo, hi = max(first, k - wide * (p + GAP)), min(last, k + n + wide * (len(t) - p - n + GAP))
                        # None, which equals no word, keeps the far ends from being matched as ends.
                        left = [(k - 1 - x, p - 1 - y) for x, y in align([*own[lo:k][::-1], None], t[:p][::-1])][::-1]
                        right = [(k + n + x, p + n + y) for x, y in align([*own[k + n : hi], None], t[p + n :])]
                        got = [x for x in self._whole(name, left + [(k + m, p + m) for m in range(n)] + right) if x[0][0] <= k <= x[-1][0]]
                        found += got
                        for x in got:
                            mark(x, done)
                        if got or wide == 1 and 2 * (len(left) + n + len(right)) < self.coverage * len(t):
                            break
        found.sort(key=lambda x: (-len(x), x[-1][0] - x[0][0], x[0][0]))
        out: list[list[tuple[int, int]]] = []
        for x in found:
            at = bisect_left(out, x[0][0], key=lambda o: o[-1][0])
            if at == len(out) or out[at][0][0] > x[-1][0]:
                out.insert(at, x)
                mark(x, held)
                if len(x) == len(t) == x[-1][0] + 1 - x[0][0]:
                    mark(x, exact)
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each copy of the templates found, by length, coverage and place; left out are templates whose phrases a longer one explains, or, of those without, whose stretch lies in that of a longer one."""
        low = text.lower() if text else ""
        if not any(w in low for w in self.rare):
            return []
        own = words(low)
        have = self.rare.keys() & set(own)
        if not have:
            return []
        many, found, exact, held = None, [], None, None
        for name in sorted({k for w in have for k in self.rare[w]}, key=lambda k: (-len(self.templates[k]), k)):
            many = many or Counter(own)
            exact, held = exact or bytearray(len(own)), held or bytearray(len(own))
            t = self.templates[name]
            if sum(min(n, many[w]) for w, n in self.counts[name].items()) < self.coverage * len(t):
                continue
            found += [(name, round(len(x) / len(t), 4), x, len(t)) for x in self.copies(name, own, exact, held)]
        found.sort(key=lambda x: (-x[3], -x[1], x[0], x[2][0][0]))
        out: list[tuple[str, float, int, int]] = []
        taken: set[int] = set()
        for name, c, best, _ in found:
            lo, hi, own_places = best[0][0], best[-1][0], self.places(name, best)
            if own_places <= taken if own_places else any(x[2] <= lo and hi <= x[3] for x in out):
                continue
            out.append((name, c, lo, hi))
            taken.update(x for x, _ in best)
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word): a row for each copy of a license in each row of docs; none for null or empty texts and texts without a license. Repeated
    rows give repeated results. The templates are a fixed library. Other columns are ignored."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        s = Scanner(templates, coverage)
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for r in s.scan(t):
                    at.append(k)
                    rows.append(r)
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, first_word int, last_word int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
