"""Line deduplication against a pass with a set, the runs, and odd input."""

from __future__ import annotations

import random

import pytest

from tripleloom.llm import linededup as L

from .conftest import prose


def brute(rows):
    """[(doc_id, text, n_dropped)] of rows (doc_id, text): one pass in the order of doc_id with a set of lines seen."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out.append((d, None, 0))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            k = line.strip(L.WHITE)
            if k and k in seen:
                gone += 1
                continue
            seen.add(k)
            kept.append(line)
        out.append((d, "\n".join(kept), gone))
    return out


@pytest.mark.parametrize("batches", [1, 2, 6, 13])
def test_equals_one_pass_with_a_set(documents, batches):
    rng = random.Random(1)
    lines = [prose(rng, 4) for _ in range(60)] + ["short", "", "  padded line of text  ", "padded line of text", "ünïcödé line of text"]
    rows = [(k, "\n".join(rng.choice(lines) if rng.random() < 0.5 else prose(rng, 5) for _ in range(rng.randint(0, 12)))) for k in range(150)] + [(200, None), (201, ""), (202, "\n\n")]
    got = [(r.doc_id, r.text, r.n_dropped) for r in L.dedup(documents(rows), batches).collect()]
    assert sorted(got) == sorted(brute(rows), key=lambda r: r[0])
    assert sum(n for *_, n in got) > 100


def test_short_lines_and_all_white_space_count(documents):
    rows = [(1, "}\r\nLes.\r\n\u3000ok\u00a0"), (2, "}\nLes.\t\nok\n \n"), (3, " \n\t")]
    assert [(r.doc_id, r.text, r.n_dropped) for r in L.dedup(documents(rows)).orderBy("doc_id").collect()] == [(1, rows[0][1], 0), (2, " \n", 3), (3, " \n\t", 0)]


def test_string_ids_shared_ids_and_no_ids(spark):
    rows = [("b", "one\ntwo"), ("a", "one\nthree"), ("a", "four\nfive"), (None, "five\nsix"), (None, "six\none"), ("c", "two"), ("c", "two")] + [(f"x{k:03d}", f"line {k % 30}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    got = sorted(map(str, ((r.doc_id, r.text, r.n_dropped) for r in L.dedup(docs).collect())))
    assert got == sorted(map(str, sorted_brute(rows)))


def sorted_brute(rows):
    order = {d: k for k, d in enumerate(sorted({d for d, _ in rows if d is not None}))}
    back = {k: d for d, k in order.items()} | {None: None}
    return [(back[d], t, n) for d, t, n in brute([(order.get(d), t) for d, t in rows])]


def test_runs_are_levelled_and_merged_as_they_lie(spark):
    runs = L.Runs(spark, fanout=2)

    def hashes(a, b):
        return spark.range(a, b).selectExpr("xxhash64(id) as h", "xxhash64(1, id) as g").repartition(runs.buckets, "h", "g")

    for k in range(7):
        runs.add(runs.write(hashes(k * 10, k * 10 + 10)))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    held = [r.h for level in runs.levels for run in level for r in run.collect()]
    assert len(held) == len(set(held)) == 70
    with L._ordered_buckets(spark):
        anti, both = runs.without(hashes(65, 75)), runs.merged([runs.levels[0][0], runs.levels[1][0]])
        assert anti.count() == 5 and both.count() == 30
        plan = anti._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan
        plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 0 and plan.count("Sort [") == 0, plan
    names = list(runs.names)
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_odd_input(messy, nothing):
    rows = {}
    for r in L.dedup(messy).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == messy.count()
    assert rows[1][0].text is None and rows[2][0].text == "" and rows[3][0].text == " \n\t "
    assert sorted(r.text for r in rows[6]) == ["", "one two three four five six seven"] and sorted(r.n_dropped for r in rows[None]) == [0, 0, 1]
    assert rows[5][0].n_dropped == 1 and rows[4][0].n_dropped == 0
    assert L.dedup(nothing).count() == 0


def test_query_equals_its_sql_on_the_fixture(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(str, con.execute(f"select doc_id, text, n_dropped from ({L.ORACLE})").fetchall()))
    assert sorted(str(tuple(r)) for r in L.query(spark, sf).select("doc_id", "text", "n_dropped").collect()) == want
