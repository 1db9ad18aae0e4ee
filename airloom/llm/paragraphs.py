"""Paragraphs that repeat across scripts, by MinHash banding and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import dropped, is_empty, rewritten, written
from airloom.llm.components import connected_components

WIDTH = 5
SIMILARITY = 0.8
MIN_WORDS = 20
HASHES = 30
RECALL = 0.999
PAIRED = 64
BLOCK_WORDS = 1 << 16
SKETCH = 2048


def band_rows(similarity: float, hashes: int, recall: float) -> int:
    """The most rows per band with which a pair at the threshold still collides in some band."""
    rows = [
        r
        for r in range(1, hashes + 1)
        if hashes % r == 0 and 1 - (1 - similarity**r) ** (hashes // r) >= recall
    ]
    return max(rows, default=1)


def _split(text: str | None, min_words: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """``(number, first character, words)`` of the lines that are long enough to compare."""
    start = 0
    for number, line in enumerate((text or "").split("\n")):
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= max(1, min_words):
            yield number, start, words
        start += len(line) + 1


#: ``(text, min_words)`` to the paragraphs to compare.
Split = Callable[[str | None, int], Iterator[tuple[int, int, list[bytes]]]]


def _key(words: list[bytes]) -> int:
    value = xxhash.xxh3_64_intdigest(b" ".join(words))
    return value - (1 << 64) if value >> 63 else value


def hashed(words: Iterable[bytes]) -> np.ndarray:
    """XXH64 of every word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)


def _combined(hashes: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = (total + hashes[i : len(hashes) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _shingles(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for every run of five words (all words, if fewer), in order."""
    return _combined(hashed(words), min(WIDTH, len(words)))


def _all_shingles(paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several paragraphs in a row, and where those of each start."""
    lengths = np.array([len(words) for words in paragraphs])
    if lengths.min() < WIDTH:
        shingles = [_shingles(words) for words in paragraphs]
        return np.concatenate(shingles), np.cumsum([0] + [len(s) for s in shingles[:-1]])
    ends = np.cumsum(lengths)
    # Runs over the end of a paragraph are none.
    inside = np.ones(ends[-1], dtype=bool)
    for back in range(1, WIDTH):
        inside[ends - back] = False
    flat = _combined(hashed(chain.from_iterable(paragraphs)), WIDTH)[inside[: ends[-1] - WIDTH + 1]]
    counts = lengths - WIDTH + 1
    return flat, np.cumsum(counts) - counts


def _bands(paragraphs: list[list[bytes]], rows: int) -> np.ndarray:
    """One number per band for each of several paragraphs, from the minima of seeded hashes."""
    flat, starts = _all_shingles(paragraphs)
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    bands = np.zeros((len(paragraphs), HASHES // rows), dtype=np.uint64)
    for i in range(HASHES):
        mixed = flat * odd[i] + shift[i]
        least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        band = i // rows
        bands[:, band] = (bands[:, band] ^ least) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(band)
    return bands.view(np.int64)


def paragraph_bands(
    content: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    min_words: int = MIN_WORDS,
    rows: int = 4,
    split: Split = _split,
) -> DataFrame:
    """``(content_id, paragraph, start, n_words, key, bands)`` for the lines with ``min_words``.

    ``key`` is a 64-bit hash of the line's words in lower case (A-Z), so lines that differ in
    case or spacing are the same text.
    """
    kind = content.select(content_id).schema[0].dataType
    names = ["content_id", "paragraph", "start", "n_words", "key", "bands"]

    def batch_of(found: list[tuple], ids: pa.DataType, rows: int) -> pa.RecordBatch:
        bands = _bands([f[5] for f in found], rows)
        offsets = np.arange(len(found) + 1, dtype=np.int32) * bands.shape[1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], ids),
                pa.array([f[1] for f in found], pa.int32()),
                pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.int64()),
                pa.array([f[4] for f in found], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1))),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words_in = [], 0
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                for number, start, words in split(text.as_py(), min_words):
                    key = _key(words)
                    found.append((id_.as_py(), number, start, len(words), key, words))
                    words_in += len(words)
                    if words_in >= BLOCK_WORDS:
                        yield batch_of(found, batch.column(0).type, rows)
                        found, words_in = [], 0
            if found:
                yield batch_of(found, batch.column(0).type, rows)

    return content.select(F.col(content_id), F.col(script).cast("string")).mapInArrow(
        run,
        f"content_id {kind.simpleString()}, paragraph int, start bigint, n_words bigint, "
        "key bigint, bands array<bigint>",
    )


def _shingle_sets(
    content: DataFrame, script: str, keys: DataFrame, min_words: int, split: Split
) -> DataFrame:
    """``(key, shingles, size, sketch)`` of the wanted paragraphs, each once; shingles as a sorted set.

    The sketch has a bit for each of ``SKETCH`` bins: whether an odd number of the shingles fall into it.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {
                _key(words): b" ".join(words)
                for text in batch.column(0)
                for _, _, words in split(text.as_py(), min_words)
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())],
                ["key", "text"],
            )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_shingles(t.as_py().split())) for t in batch.column(1)]
            signed = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
            sizes = pa.array([len(f) for f in found], pa.int32())
            sketches = pa.array([_sketch(f) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), signed, sizes, sketches], ["key", "shingles", "size", "sketch"]
            )

    lines = content.select(F.col(script).cast("string")).mapInArrow(texts, "key bigint, text binary")
    wanted = lines.join(keys, "key", "left_semi").dropDuplicates(["key"])
    return wanted.mapInArrow(sets, "key bigint, shingles array<bigint>, size int, sketch array<bigint>")


def _sketch(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _maybe(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` that can be similar enough by the sizes and sketches of their sets.

    A shingle that only one set has changes one bit, so sketches differ in no more bits than the sets
    do in shingles. That is at most (1 - s) / (1 + s) of the sizes' sum at similarity s, so no such pair is
    left out, and only few others remain of sets that the sketch is not too short for.
    """
    left, right = (
        sets.select(F.col("key").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        for side in "ab"
    )
    size, other = F.col("size_a"), F.col("size_b")
    near = F.least(size, other) >= F.lit(similarity) * F.greatest(size, other) - F.lit(1e-9)
    bits = [F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(SKETCH // 64)]
    most = (size + other) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    return pairs.join(left, "a").join(right, "b").where(near & (sum(bits[1:], bits[0]) <= most)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are similar enough, exactly, as a table.

    The sets themselves move only for pairs that their sketches, a fraction as long, do not rule out.
    """
    likely = written(_maybe(pairs, sets, similarity), "paragraph-likely")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    together = F.size("sa") + F.size("sb") - shared
    links = written(
        likely.join(left, "a")
        .join(right, "b")
        .where(shared >= F.lit(similarity) * together - F.lit(1e-9))
        .select("a", "b"),
        "paragraph-links",
    )
    dropped(likely)
    return links


def _outer_centres(full: DataFrame, most: DataFrame) -> DataFrame:
    """``(band, centre)`` of full bands, as a table: the centre that the band's own one has elsewhere.

    ``most`` has the text of each band that meets most others, ``(band, most)``. Of the bands that this
    text is in, it takes the centre that meets most, and so on until that text is its own. A band without the
    origin of its copies is thus placed under the origin, and a text, which is in ten bands, under few centres.
    """
    inner = most.select(F.col("most.key").alias("key")).distinct()
    step = written(
        full.join(inner, "key", "left_semi")
        .join(most, "band")
        .groupBy("key")
        .agg(F.max("most").getField("key").alias("centre")),
        "paragraph-outer",
    )
    # Every step doubles the way; the texts on it meet more and more, so it ends.
    while True:
        ahead = step.join(step.select(F.col("key").alias("centre"), F.col("centre").alias("next")), "centre")
        if is_empty(ahead.where("centre <> next")):
            break
        further = written(ahead.select("key", F.col("next").alias("centre")), "paragraph-outer")
        dropped(step)
        step = further
    centres = written(
        most.select("band", F.col("most.key").alias("key")).join(step, "key").select("band", "centre"),
        "paragraph-centres",
    )
    dropped(step)
    return centres


def _difference_pairs(sets: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different classes under one centre that may be similar enough, as a table.

    ``placed`` has ``(key, centre, class)``. What a text and its centre do not share is the text's
    difference. Two texts differ in what stands in just one of their differences, and at similarity
    s in at most (1 - s) / (1 + s) of their sizes' sum. So their differences must share a number of
    shingles that grows with how far both are from the centre, and then share one of the first few,
    in any common order. The rarest come first, so edits that no other text has use up
    these places. Two texts whose differences need not share anything are both linked to the centre.
    """
    centres = written(
        sets.join(placed.select(F.col("centre").alias("key")).distinct(), "key", "left_semi").select(
            F.col("key").alias("centre"), F.col("shingles").alias("middle")
        ),
        "paragraph-middles",
    )
    apart = F.array_union(F.array_except("shingles", "middle"), F.array_except("middle", "shingles"))
    differences = written(
        placed.join(sets, "key")
        .join(centres, "centre")
        .select("centre", "key", "class", F.size("shingles").alias("size"), apart.alias("apart")),
        "paragraph-differences",
    )
    dropped(centres)
    single = differences.select("centre", "key", "class", "size", F.explode("apart").alias("shingle"))
    counts = written(
        single.groupBy("centre", "shingle").agg(
            F.count(F.lit(1)).alias("n"), (F.min("class") < F.max("class")).alias("mixed")
        ),
        "paragraph-shingles",
    )
    length = F.floor(F.col("size") * ((1 - similarity) / similarity) + F.lit(1e-9)).cast("int") + 1
    prefixes = written(
        single.join(counts, ["centre", "shingle"])
        .groupBy("centre", "key", "class", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "mixed"))).alias("ordered"))
        .select(
            "centre", "key", "class", "size", F.size("ordered").alias("apart"),
            F.posexplode(F.slice("ordered", F.lit(1), length)).alias("place", "o"),
        )
        .where("o.mixed")
        .select("centre", "key", "class", "size", "apart", "place", F.col("o.shingle").alias("shingle")),
        "paragraph-prefixes",
    )
    dropped(differences, counts)
    left, right = (
        prefixes.select(
            "centre", "shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "class", "size", "apart", "place"))
        )
        for side in "ab"
    )
    size, other = F.col("size_a"), F.col("size_b")
    near = F.least(size, other) >= F.lit(similarity) * F.greatest(size, other) - F.lit(1e-9)
    most = (size + other) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-9)
    shared = (F.col("apart_a") + F.col("apart_b") - most) / 2
    early = (F.col("place_a") <= F.col("apart_a") - shared) & (F.col("place_b") <= F.col("apart_b") - shared)
    further = written(
        left.join(right, ["centre", "shingle"])
        .where((F.col("key_a") < F.col("key_b")) & (F.col("class_a") != F.col("class_b")) & near & early)
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
        .distinct(),
        "paragraph-further",
    )
    dropped(prefixes)
    return further


def linked(
    found: DataFrame,
    content: DataFrame,
    script: str,
    similarity: float,
    min_words: int,
    paired: int,
    split: Split,
) -> DataFrame:
    """``(key, class)`` of the texts of ``found`` that have a near copy; see :func:`repeated_paragraphs`."""
    banded = found.select("key", F.posexplode("bands").alias("number", "band")).select(
        F.xxhash64("number", "band").alias("band"), "key"
    )
    # Bands with a single text, most of them, end here; copies are merged before the shuffle.
    met = written(
        banded.groupBy("band")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .where(F.col("first") < F.col("last"))
        .select("band", "first"),
        "paragraph-met",
    )
    shared = written(banded.join(met, "band").distinct(), "paragraph-shared")
    sizes = written(shared.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "paragraph-sizes")
    members = written(shared.drop("first").join(sizes, "band"), "paragraph-members")
    dropped(met, shared, sizes)
    sets = written(
        _shingle_sets(content, script, members.select("key").distinct(), min_words, split), "paragraph-sets"
    )
    small = members.where(F.col("n") <= paired).select("band", "key")
    pairs = (
        small.withColumnRenamed("key", "a")
        .join(small.withColumnRenamed("key", "b"), "band")
        .where(F.col("a") < F.col("b"))
        .select("a", "b")
    )
    # The text that meets most others in full bands is the likeliest origin of their copies.
    full = members.where(F.col("n") > paired)
    met_most = written(full.groupBy("key").agg(F.sum("n").alias("meets")), "paragraph-meets")
    most = written(
        full.join(met_most, "key").groupBy("band").agg(F.max(F.struct("meets", "key")).alias("most")),
        "paragraph-most",
    )
    dropped(met_most)
    centres = _outer_centres(full, most)
    # Stars around both: the band's own centre is the nearer one, the outer one is what differences are taken from.
    both = most.select("band", F.col("most.key").alias("centre")).unionByName(centres)
    stars = (
        full.join(both, "band")
        .where(F.col("key") != F.col("centre"))
        .select(F.least("centre", "key").alias("a"), F.greatest("centre", "key").alias("b"))
    )
    candidates = written(pairs.unionByName(stars).distinct(), "paragraph-pairs")
    dropped(most)
    links = _verified(candidates, sets, similarity)
    dropped(candidates)
    classes = written(connected_components(links), "paragraph-classes")
    crowded = (
        members.where(F.col("n") > paired)
        .join(classes.select(F.col("node").alias("key"), F.col("component").alias("class")), "key", "left")
        .withColumn("class", F.coalesce("class", "key"))
    )
    mixed = written(
        crowded.groupBy("band")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("band"),
        "paragraph-mixed",
    )
    if not mixed.isEmpty():
        placed = written(
            crowded.join(mixed, "band", "left_semi").join(centres, "band").select("key", "centre", "class").distinct(),
            "paragraph-placed",
        )
        maybe = _difference_pairs(sets, placed, similarity)
        further = _verified(maybe, sets, similarity)
        dropped(classes)
        classes = written(connected_components(links.unionByName(further)), "paragraph-classes")
        dropped(placed, maybe, further)
    dropped(members, sets, centres, links, mixed)
    return classes.select(F.col("node").alias("key"), F.col("component").alias("class"))


def repeated_paragraphs(
    content: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS,
    paired: int = PAIRED,
) -> DataFrame:
    """Every paragraph (line of ``min_words`` words or more) that has a copy or near copy.

    ``(content_id, paragraph, start, n_words, class_content_id, class_paragraph, n_paragraphs,
    removed)``: lines are counted from 0, ``start`` is the first character's place, and a class is
    named by its first paragraph in order of id and line, the only one that is not ``removed``.

    Paragraphs are near copies if the Jaccard similarity of their shingles of five words is
    ``similarity`` or more, and classes are the components of that relation. Equal texts are one
    text from the start. Texts meet in MinHash bands, with as many rows per band as still find a
    pair at the threshold with probability 0.999. Bands with up to ``paired`` texts are compared
    pair by pair. The texts of fuller bands are compared with the one of them that meets most, their
    centre. Once that has made classes, texts of bands that still hold several are joined on the rarest
    shingles in which they differ from the centre, across classes only, which finds every remaining
    link without all pairs (:func:`_difference_pairs`).

    Rows that repeat an id and paragraph are one paragraph; NULL ids are ids in order before
    others. NULL and empty scripts have no paragraphs. Other columns are left out.
    """
    rows = band_rows(similarity, HASHES, RECALL)
    found = written(paragraph_bands(content, content_id, script, min_words, rows), "paragraph-bands")
    classes = linked(found, content, script, similarity, min_words, paired, _split)
    places = found.groupBy("key").agg(
        F.min(F.struct("content_id", "paragraph")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    placed = written(places, "paragraph-places")
    classed = written(
        placed.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key")),
        "paragraph-classed",
    )
    named = written(
        classed.groupBy("class")
        .agg(F.min("first").alias("first"), F.sum("n").alias("n_paragraphs"))
        .where(F.col("n_paragraphs") > 1),
        "paragraph-named",
    )
    repeated = written(
        classed.select("key", "class").join(named, "class").select("key", "first", "n_paragraphs"),
        "paragraph-repeated",
    )
    dropped(placed, classed, named)
    own = F.struct("content_id", "paragraph")
    lines = written(
        found.drop("bands").join(repeated, "key").select(
            "content_id",
            "paragraph",
            "start",
            "n_words",
            F.col("first.content_id").alias("class_content_id"),
            F.col("first.paragraph").alias("class_paragraph"),
            "n_paragraphs",
            (~own.eqNullSafe(F.col("first"))).alias("removed"),
        ),
        "paragraph-lines",
    )
    dropped(found, repeated)
    return lines


def without_repeats(
    content: DataFrame, repeated: DataFrame, content_id: str = "content_id", script: str = "script"
) -> DataFrame:
    """``content`` with the removed paragraphs of :func:`repeated_paragraphs` cut from the scripts.

    Rows without an id keep their scripts as they are, and so do NULL scripts. Columns may have any names.
    """
    lines = written(
        repeated.where("removed")
        .groupBy(F.col("content_id").alias("_id"))
        .agg(F.collect_set("paragraph").alias("_removed")),
        "paragraph-removed",
    )
    kept = F.filter(
        F.split(F.col("_script"), "\n"), lambda line, i: ~F.array_contains(F.col("_removed"), i)
    )
    text = F.when(F.col("_removed").isNull(), F.col("_script")).otherwise(F.concat_ws("\n", kept))
    return rewritten(content, lines, content_id, script, text)
