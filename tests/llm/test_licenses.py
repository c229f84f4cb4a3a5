"""Alignment properties, coverage of planted licenses, the bounds against scanning without them, and odd input."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleloom.llm import licenses as P
from tripleloom.llm.common import words
from tripleloom.llm.license_texts import TEMPLATES

from .conftest import prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=25))
def test_alignment_is_increasing_and_of_equal_words(a, b):
    out = P.align(a, b)
    assert all(a[x] == b[y] for x, y in out)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(out, out[1:]))


def test_alignment_of_equal_and_edited_texts():
    w = words(TEMPLATES["MIT"])
    assert P.align(w, w) == [(k, k) for k in range(len(w))]
    edited = w[:20] + ["extra"] * 3 + w[20:60] + w[62:]
    assert len(P.align(edited, w)) >= len(w) - 4


def longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    return max(best, default=0)


def test_anchors_are_a_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a = [f"w{k}" for k in range(12)]
        b = rng.sample(a, 12)
        assert len(P.align(["<"] + a + [">"], ["("] + b + [")"])) == longest([b.index(x) for x in a])


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_is_found_in_a_text(name):
    rng = random.Random(2)
    text = prose(rng, 300) + "\n" + TEMPLATES[name] + "\n" + prose(rng, 300)
    got = P.Scanner().scan(text)
    best = next(x for x in got if x[0] == name or len(words(TEMPLATES[x[0]])) > len(words(TEMPLATES[name])))
    assert best[1] == 1.0 and (best[0] != name or best[2] == 300)


def test_edited_license_is_found_with_its_coverage():
    rng = random.Random(3)
    w = TEMPLATES["MIT"].split()
    for k in rng.sample(range(len(w)), len(w) // 12):
        w[k] = "changed"
    got = P.Scanner().scan(prose(rng, 100) + " " + " ".join(w))
    assert [x[0] for x in got] == ["MIT"] and 0.85 <= got[0][1] < 1.0


def test_prose_has_none_and_half_a_license_is_too_little():
    rng = random.Random(4)
    assert P.Scanner().scan(prose(rng, 2000)) == []
    half = " ".join(TEMPLATES["MIT"].split()[:80])
    assert "MIT" not in [x[0] for x in P.Scanner().scan(half)]


def test_bounds_lose_nothing():
    """Against alignment of every text with every template, around every place."""
    rng = random.Random(5)
    s = P.Scanner()
    for k in range(40):
        own = []
        for _ in range(rng.randint(0, 3)):
            t = TEMPLATES[rng.choice(sorted(TEMPLATES))].split()
            a = rng.randrange(len(t) // 3 + 1)
            own += prose(rng, rng.randint(0, 60)).split() + t[a:]
        text = " ".join(own)
        w = words(text)
        found = set()
        for name, t in s.templates.items():
            if any(len(P.densest(P.align(w[i : i + len(t) + P.GAP], t))) >= s.coverage * len(t) for i in range(max(1, len(w)))):
                found.add(name)
        got = {x[0] for x in s.scan(text)}
        longer = {n for n in found if any(set(s.templates[n]) <= set(s.templates[m]) or n != m for m in got)}
        assert got <= found | got and found - got <= longer, (found, got)
        assert bool(got) == bool(found)


def test_odd_input(messy, nothing):
    assert P.scan(messy).count() == 0 == P.scan(nothing).count()


def test_rows_are_scanned_by_themselves(documents):
    rng = random.Random(6)
    mit = TEMPLATES["MIT"]
    rows = [(1, mit), (1, mit), (None, mit), (2, None), (3, ""), (4, prose(rng, 80_000) + " " + mit)]
    got = [tuple(r) for r in P.scan(documents(rows)).collect()]
    n = len(words(mit))
    assert sorted(map(str, got)) == sorted(map(str, [(1, "MIT", 1.0, 0, n - 1)] * 2 + [(None, "MIT", 1.0, 0, n - 1), (4, "MIT", 1.0, 80_000, 80_000 + n - 1)]))


def test_query_equals_scanning_each_text(spark, sf):
    s = P.Scanner()
    want = sorted(str((r.doc_id, *x)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in s.scan(r.text))
    assert sorted(str(tuple(r)) for r in P.query(spark, sf).collect()) == want


NEIGHBOURS = {
    "Released under the BSD License": "BSD statement",
    "Released under the Apache License.": "Apache statement",
    "Licensed under CC BY 4.0": "CC-BY-4.0 short statement",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0 statement",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0 statement",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0 statement",
    "Released under the GNU General Public License, version 3.": "GPL-3.0 short statement",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0 long statement",
    TEMPLATES["GPL-3.0"].replace("version 3", "version 2"): "GPL-2.0",
    TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Affero General"): "AGPL-3.0",
}


@pytest.mark.parametrize("line", sorted(NEIGHBOURS))
def test_neighbouring_licenses_are_told_apart(line):
    rng = random.Random(8)
    got = P.Scanner().scan(prose(rng, 40) + "\n" + line + "\n" + prose(rng, 40))
    assert [x[0] for x in got] == [NEIGHBOURS[line]]


def test_a_license_without_a_template_is_not_given_as_another():
    for line in ("Released under the Foo License.", "Licensed under CC BY-XX 4.0.", "Licensed under the Educational Community License, Version 2.0."):
        assert P.Scanner().scan(line) == []


def test_two_licenses_in_one_sentence_are_both_found():
    got = P.Scanner().scan("Released under the MIT License or the Apache License, Version 2.0.")
    assert {x[0] for x in got} == {"MIT statement", "Apache-2.0 statement"}


@pytest.mark.parametrize("name", ["CC-BY-NC-4.0 statement", "MIT statement", "Apache-2.0 statement", "GPL-3.0 statement", "GPL-3.0", "MIT", "BSD-2-Clause", "Unlicense"])
@pytest.mark.parametrize("many", [2, 5])
@pytest.mark.parametrize("between", [0, 5, 60])
def test_each_copy_is_found(name, many, between):
    rng = random.Random(9)
    n, text, want = len(words(TEMPLATES[name])), prose(rng, 100), []
    for k in range(many):
        want.append((name, 1.0, 100 + k * (n + between), 99 + k * (n + between) + n))
        text += "\n" + TEMPLATES[name] + "\n" + prose(rng, between)
    assert P.Scanner().scan(text + prose(rng, 100)) == want


def test_edited_copies_are_found_beside_each_other():
    line = "Licensed hereby under CC BY-NC 4.0."
    assert [x[2:] for x in P.Scanner().scan("some prose before\n" + (line + "\n") * 3 + "and some after")] == [(3 + 8 * k, 10 + 8 * k) for k in range(3)]
    lines = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0."]
    assert [x[0] for x in sorted(P.Scanner().scan("\n".join(lines * 2)), key=lambda x: x[2])] == ["CC-BY-NC-4.0 statement", "CC-BY-SA-4.0 statement"] * 2
