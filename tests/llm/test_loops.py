"""Loops in scripts against a search of every period."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from airloom.llm import records
from airloom.llm.loops import chunks, loops_of, script_loops
from airloom.llm.queries import QUERIES

KIND = "content_id long, script string"


def plain(words):
    """Every maximal stretch of every period, in time words x periods."""
    found = {}
    for period in range(1, len(words) // 3 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(24, 3 * period):
                found.setdefault((at, length), period)
            at = max(end, at + 1)
    loops = sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))
    strongest = min(loops, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if loops else None
    dropped = {i for s, n, p in loops for i in range(s + p, s + n)}
    return len(words), loops, strongest, b" ".join(w for i, w in enumerate(words) if i not in dropped)


def odd_words(rng):
    if rng.random() < 0.4:
        return [b"%d" % rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(300))]
    words = []
    for _ in range(rng.randrange(1, 5)):
        turn = [b"%d" % rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 40))]
        words += (turn * rng.randrange(1, 9))[: rng.randrange(1, 400)]
        words *= rng.choice([1, 1, 3])
    return words[:500]


@pytest.mark.parametrize("seed", range(4))
def test_equals_search_of_every_period(seed):
    rng = random.Random(seed)
    for _ in range(25):
        scripts = [odd_words(rng) for _ in range(rng.randrange(1, 6))]
        assert [*loops_of(scripts)] == [plain(words) for words in scripts]


def test_loops_do_not_reach_into_the_next_script():
    loop = [b"a", b"b"] * 10
    assert [x[1] for x in loops_of([loop, loop, [], loop])] == [[], [], [], []]
    assert [x[1] for x in loops_of([loop + loop, loop])] == [[(0, 40, 2)], []]


def test_chunks_are_bounded_and_whole():
    assert [*chunks([])] == [] and [*chunks([9, 9], 5)] == [(0, 1), (1, 2)]
    assert [*chunks([1, 2, 3, 4, 9, 1], 5)] == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]


def test_odd_rows(spark):
    loop = " ".join(["ping", "pong"] * 12)
    rows = [
        (1, None), (1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (None, loop), (4, f"intro {loop} outro"),
        (4, f"intro {loop} outro"), (5, "wörd x " * 30), (6, " ".join(["ping", "pong"] * 11)),
    ]
    names = ("loops", "id", "_script", "n_words", "strongest", "collapsed")
    df = spark.createDataFrame(rows, KIND).withColumns({n: F.lit(1) for n in names})
    found = sorted(script_loops(df).collect(), key=str)
    shown = [(r.content_id, r.n_words, [tuple(x) for x in r.loops], r.strongest and tuple(r.strongest), r.collapsed) for r in found]
    run = (1, 24, 2)
    assert sorted(shown, key=str) == sorted(
        [
            (1, 0, [], None, ""), (1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""),
            (None, 24, [(0, 24, 2)], (0, 24, 2), "ping pong"), (4, 26, [run], run, "intro ping pong outro"),
            (4, 26, [run], run, "intro ping pong outro"), (5, 30, [(0, 30, 1)], (0, 30, 1), "wörd x"),
            (6, 22, [], None, " ".join(["ping", "pong"] * 11)),
        ],
        key=str,
    )
    assert script_loops(df.limit(0)).count() == 0


def test_very_long_script(spark):
    turn = [f"w{i}" for i in range(10_000)]
    rows = [(1, " ".join(turn * 5 + ["end"])), (2, "spam " * 100_000)]
    found = {r.content_id: r for r in script_loops(spark.createDataFrame(rows, KIND)).collect()}
    assert [tuple(x) for x in found[1].loops] == [(0, 50_000, 10_000)] and found[1].collapsed.split() == [*turn, "end"]
    assert [tuple(x) for x in found[2].loops] == [(0, 100_000, 1)] and found[2].collapsed == "spam"


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    expected = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        _, loops, best, collapsed = plain(words) if n < 3000 else next(loops_of([words]))
        text = "".join(f"{s},{n},{p}\n" for s, n, p in loops)
        digests = [hashlib.sha256(x).hexdigest() for x in (text.encode(), collapsed)]
        expected.append((r.doc_id, len(loops), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
    found = [tuple(r) for r in QUERIES["op12_script_loops"](spark, folder).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str) and sum(r[1] > 0 for r in found) > 5


def test_planted_loops_leave_odd_rows_alone(spark):
    rows = [(None, "a b c", None, None), (11, None, None, None), (11, "", None, None), (11, "  ", None, None)]
    df = spark.createDataFrame(rows, "content_id long, script string, language string, blogger string")
    assert sorted(map(str, records.looped(df).collect())) == sorted(map(str, df.collect()))
