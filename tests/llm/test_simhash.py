from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from airloom.llm.components import connected_components
from airloom.llm.queries import QUERIES
from airloom.llm.simhash import close_links, fingerprint, golay_keys, near_duplicates

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    """Straight from the definition."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        low = low.replace(gap, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def plain_components(prints):
    """``prints``: (id, fingerprint); the component of each row, pair by pair."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[find(i)] = find(j)
    smallest = {}
    for i, (id_, _) in enumerate(prints):
        ids = [x for x in (smallest.get(find(i)), id_) if x is not None]
        smallest[find(i)] = min(ids, default=None)
    return [smallest[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "a b c", "É É a b C d é", "x " * 5000])
def test_fingerprint_by_definition(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same_xxh64(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 22, 20000)
    for flips in (0, 1, 2):
        other = words.copy()
        places = np.argsort(rng.random((len(words), 22)), axis=1)[:, :flips]
        for k in range(flips):
            other ^= 1 << places[:, k]
        a, b = golay_keys(words), golay_keys(other)
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


@pytest.mark.parametrize("paired", [2, 64])
def test_links_equal_brute_force(spark, paired):
    rng = random.Random(paired)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = set(centres)
    for centre in centres[:5]:
        for _ in range(60):
            value = centre
            for _ in range(rng.randrange(5)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    values |= {0, 1, 3, 2**64 - 1}
    rows = [(v - 2**64 if v >> 63 else v,) for v in values]
    links = close_links(spark.createDataFrame(rows, "fingerprint bigint"), paired)
    found = {r.node: r.component for r in connected_components(links).collect()}
    expected = plain_components([(v[0], v[0] % 2**64) for v in rows])
    assert [found.get(v[0], v[0]) for v in rows] == expected


def test_components_of_a_path_a_star_and_nulls(spark):
    path = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, i) for i in range(1001, 1400)]
    links = spark.createDataFrame([*path, *star, (None, 5), (7, None), (5000, 5000)], "a long, b long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 201)}, **{i: 1000 for i in range(1000, 1400)}}


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten " * 20
    rows = [
        (3, None), (1, ""), (2, "\n"), (None, text), (9, text), (9, text), (8, text + "eleven"),
        (None, "something else altogether here"), (20, "word " * 200_000),
    ]
    df = spark.createDataFrame(rows, "content_id long, script string")
    df = df.withColumn("fingerprint", F.lit("x")).withColumn("component_id", F.lit(1))
    found = near_duplicates(df)
    assert found.columns == ["content_id", "fingerprint", "component_id"]
    got = sorted(((r[0], r[1] % 2**64, r[2]) for r in found.collect()), key=str)
    prints = [(i, plain_fingerprint(t) if i != 20 else fingerprint(t)) for i, t in rows]
    expected = sorted(
        ((*p, c) for p, c in zip(prints, plain_components(prints), strict=True)), key=str
    )
    assert got == expected
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_groups"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    components = plain_components(prints)
    assert found == {i: (f"{p:016x}", c) for (i, p), c in zip(prints, components, strict=True)}
    assert len(set(components)) < len(components)
