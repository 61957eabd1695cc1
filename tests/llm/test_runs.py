"""Periodic runs against every period tried by hand."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessitura.llm import periodic_runs

from .conftest import documents, prose


def brute(words, least=6, exponent=4):
    """All stretches of each period, word by word; the smallest period of a stretch stays."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        j = 0
        while j + q < len(words):
            s = j
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - s + q >= max(least, exponent * q):
                found.setdefault((s, j - s + q), q)
            j += j == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, words, length):
    out = []
    while len(out) < length:
        out += [rng.choice(words) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 9)
    return out


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (3, 2), (8, 3)])
def test_runs_of_lists(least, exponent):
    rng = random.Random(least)
    for _ in range(150):
        lists = [periodic(rng, [b"a", b"b", b"c"][: rng.randrange(1, 4)], rng.randrange(60)) for _ in range(rng.randrange(1, 6))]
        assert periodic_runs.runs_of(lists, least, exponent) == [brute(w, least, exponent) for w in lists]


def test_long_lists():
    assert periodic_runs.runs_of([[b"a"] * 100_000, [], [b"b"] * 5]) == [[(0, 100_000, 1)], [], []]
    piece = [b"%d" % i for i in range(7_000)]
    assert periodic_runs.runs_of([[b"x"] + piece * 4 + [b"y"], piece * 4]) == [[(1, 28_000, 7_000)], [(0, 28_000, 7_000)]]


def report(rows):
    """The contract, word by word, of (doc_id, text) rows."""
    for doc_id, text in rows:
        words = periodic_runs.repeat_tail(doc_id, (text or "").encode().split())
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        yield (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report(spark, rng):
    rows = [(i, prose(rng, rng.randrange(1, 90))) for i in range(60)]
    rows += [(100 + i, " ".join(periodic(rng, ["a", "b", "é"], 70))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "x " * 6), (204, "x y\u0085z"), (None, "r " * 9), (None, None), (100, rows[60][1]), (-7, "q w " * 8), (205, "go on " * 500)]
    got = periodic_runs.run_report(documents(spark, rows))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, report(rows)))
    small = periodic_runs.run_report(documents(spark, rows), block_words=1)
    assert sorted(map(str, small.collect())) == sorted(map(str, got.collect()))


def test_repeated_tail():
    words = [b"%d" % i for i in range(100)]
    changed = {i: periodic_runs.repeat_tail(i, words) for i in range(200)}
    assert 5 < sum(w != words for w in changed.values()) < 40
    assert all(len(w) == 100 for w in changed.values()) and periodic_runs.repeat_tail(3, []) == []


def test_large_ids_beside_nulls(spark):
    frame = spark.createDataFrame([((1 << 60) + 1, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in periodic_runs.run_report(frame).collect()} == {(1 << 60) + 1, None}


def test_columns_and_empty_table(spark, rng):
    frame = documents(spark, [(1, "a b " * 5), (2, None)]).withColumn("found", F.lit(1)).withColumn("runs", F.lit("old"))
    got = {r.doc_id: r for r in periodic_runs.find_runs(frame).collect()}
    assert [tuple(r) for r in got[1].runs.found] == [(0, 10, 2)] and got[1].runs.collapsed == "a b" and got[1].found == 1
    assert got[2].runs.n_words == 0 and got[2].runs.found == [] and set(got[2].asDict()) == set(frame.columns)
    assert periodic_runs.find_runs(frame.limit(0)).count() == 0 and periodic_runs.run_report(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(frame, exponent=1)
