"""The pipeline against a stage-by-stage computation in plain Python, and on odd rows."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airloom.llm import records
from airloom.llm.votes import fit_votes, text_counts, votes
from tests.llm.test_simhash import plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def is_leaked(text, windows):
    found, hit = terms(text), set()
    for i in range(len(found)):
        for window in windows:
            if tuple(found[i : i + len(window)]) == window:
                hit.update(range(i, i + len(window)))
    return bool(hit) and 20 * len(hit) >= len(found)


def plain_near_copies(texts):
    """The smallest id of each text's group: fingerprints two bits apart, or five-word shingles 0.8 alike."""
    prints, shingles = {}, {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        prints[i] = plain_fingerprint(text)
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    first = {i: i for i in texts}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        shared = len(shingles[a] & shingles[b])
        alike = shared and 5 * shared >= 4 * (len(shingles[a]) + len(shingles[b]) - shared)
        if alike or (prints[a] ^ prints[b]).bit_count() <= 2:
            low, high = sorted((root(a), root(b)))
            first[high] = low
    return {i: root(i) for i in texts}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    learned = records.fold_of(F.col("content_id"), 3) != 1
    model = fit_votes(
        records.as_scripts(docs).where(learned), records.reviews(spark, FOLDER).where(learned)
    )
    scores = votes(model, text_counts([r.text.encode() for r in rows.values()]))
    kept = [i for i, score in zip(rows, scores, strict=True) if score >= 0.5]
    stage = corpus_pipeline.classify(spark, docs, FOLDER)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == sorted(kept)

    groups = plain_near_copies({i: rows[i].text for i in kept})
    assert sum(i != c for i, c in groups.items()) > 3
    kept = [i for i in kept if groups[i] == i]
    stage = corpus_pipeline.deduplicate(spark, stage, FOLDER)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == sorted(kept)

    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        found = terms(r.text)
        windows |= {tuple(found[i : i + 13]) for i in range(max(1, len(found) - 12))} if found else set()
    kept = [i for i in kept if not is_leaked(rows[i].text, windows)]
    stage = corpus_pipeline.decontaminate(spark, stage, FOLDER)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == sorted(kept)

    mixed = corpus_pipeline.mix(spark, stage, FOLDER)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= set(kept) and max(copies.values()) <= 3
    sharded = corpus_pipeline.shard(spark, mixed, FOLDER).collect()
    assert Counter(r.doc_id for r in sharded) == copies
    sizes = Counter(r.shard for r in sharded)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    whole = Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert whole == Counter((r.doc_id, r.shard, r.slot) for r in sharded)


@pytest.fixture
def odd(spark):
    text = " ".join(f"plain{i} story" for i in range(60))
    rows = [
        (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " end", "en", None, None),
        (None, None, None, None, None), (None, text, "en", "a", 1), (3, "", "en", "a", 0),
        (4, "word " * 200_000, "en", "b", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({name: F.lit(1) for name in ("vote", "key", "mix", "_row", "_id", "_text", "shard", "size")})


@pytest.mark.parametrize("number", range(5))
def test_odd_and_empty_rows(spark, odd, number):
    name, stage = corpus_pipeline.STAGES[number]
    found = stage(spark, odd, FOLDER)
    rows = found.collect()
    if number < 4:
        assert found.columns == odd.columns
    expected = {1: [(1,), (3,), (4,), (None,), (None,)]}.get(number)
    if expected:
        ids = sorted(((r.doc_id,) for r in rows), key=lambda x: (x[0] is None, x[0]))
        near = [i for i in ids if i != (2,)]
        assert near == expected
    if number == 4:
        assert len(rows) == 7
    assert stage(spark, odd.limit(0), FOLDER).count() == 0
    assert np.isfinite(len(rows))
