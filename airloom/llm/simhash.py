"""Near-duplicate scripts by SimHash fingerprints and Golay-code keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import is_empty, written
from airloom.llm.components import connected_components

SEED = 42
WIDTH = 3
#: The fingerprint's segments: 22, 21 and 21 bits, each within a Golay word of 23.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the binary Golay code of length 23,
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
PAIRED = 64
EIGHTH = np.uint64(0x0101010101010101)


def fingerprint(text: str | None) -> int:
    """The SimHash of a script as an unsigned number; see :func:`fingerprints`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(words[i:] for i in range(min(WIDTH, len(words)))), strict=False)
    total, ones = max(1, len(words) - WIDTH + 1), np.zeros(64, dtype=np.int64)
    while block := [digest(b" ".join(shingle), SEED) for shingle in islice(shingles, 65536)]:
        hashes = np.array(block, dtype="<u8")
        # Every eighth bit at a time: eight counters in one number, for 255 hashes at most.
        runs = np.arange(0, len(hashes), 255)
        for bit in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(bit)) & EIGHTH, runs)
            ones[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(
    content: DataFrame, content_id: str = "content_id", script: str = "script"
) -> DataFrame:
    """``(content_id, fingerprint)``, a row per row of ``content``; the fingerprint as a bigint.

    A-Z is lower-cased; words are what ASCII white space separates. All shingles of three words
    (of a shorter script, all its words) are hashed with XXH64, repeats included, and a bit is set
    if more than half of the hashes have it. A script without words, or NULL, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], ["content_id", "fingerprint"]
            )

    kind = content.select(content_id).schema[0].dataType.simpleString()
    return content.select(F.col(content_id), F.col(script).cast("string")).mapInArrow(
        run, f"content_id {kind}, fingerprint bigint"
    )


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every word of 23 bits the nearest codeword's number, and its distance.

    The code is perfect: the 2,048 error patterns of up to three bits have all 2,048 syndromes.
    """
    def syndrome(words: np.ndarray) -> np.ndarray:
        left = words.copy()
        for bit in range(22, 10, -1):
            left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
        return left

    errors = [0]
    errors += [1 << a for a in range(23)]
    errors += [1 << a | 1 << b for a in range(23) for b in range(a)]
    errors += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
    pattern = np.zeros(2048, dtype=np.int64)
    pattern[syndrome(np.array(errors, dtype=np.int64))] = errors
    number, weight = np.empty(1 << 23, dtype=np.int16), np.empty(1 << 23, dtype=np.int8)
    for start in range(0, 1 << 23, 1 << 18):
        words = np.arange(start, start + (1 << 18), dtype=np.int64)
        nearest = pattern[syndrome(words)]
        number[words] = (words ^ nearest) >> 11
        weight[words] = np.bitwise_count(nearest)
    return number, weight


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Six codeword numbers for each word of 23 bits, repeated where there are fewer.

    A word at distance 3 from its codeword has that one and the five at distance 4, any other
    only its own. Two words that differ in at most two bits have a number in common.
    """
    if not _TABLES:
        _TABLES.append(_golay_tables())
    number, weight = _TABLES[0]
    own = number[words]
    keys = np.repeat(own[:, None], 6, axis=1)
    far = np.flatnonzero(weight[words] == 3)
    if far.size:
        # A codeword at distance 4 is the nearest one of the word with some bit turned,
        # then at distance 3 of it.
        turned = words[far][:, None] ^ (1 << np.arange(23))[None, :]
        found = np.sort(
            np.where(weight[turned] == 3, number[turned], own[far][:, None]), axis=1
        )
        new = np.ones(found.shape, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        new &= found != own[far][:, None]
        row, column = np.nonzero(new)
        place = np.cumsum(new, axis=1)[row, column]
        keys[far[row], place] = found[row, column]
    return keys


def fingerprint_keys(prints: DataFrame) -> DataFrame:
    """``(key, fingerprint)``: up to 18 keys for each fingerprint, such that any two that differ in
    at most two bits share one.

    Of three segments, one has no error. So a key is one segment as it is, and next to it a Golay
    codeword number of the following segment, which has at most two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            value = signed.view(np.uint64)
            parts = [
                ((value >> np.uint64(start)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                for start, bits in SEGMENTS
            ]
            keys = []
            for table in range(3):
                numbers = golay_keys(parts[(table + 1) % 3])
                keys.append((table << 34) | (parts[table] << 12)[:, None] | numbers)
            wide = np.sort(np.concatenate(keys, axis=1), axis=1)
            new = np.ones(wide.shape, dtype=bool)
            new[:, 1:] = wide[:, 1:] != wide[:, :-1]
            row, column = np.nonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wide[row, column]), pa.array(signed[row])], ["key", "fingerprint"]
            )

    return prints.select("fingerprint").mapInArrow(run, "key bigint, fingerprint bigint")


def close_links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints differing in at most two bits.

    Fingerprints meet under their Golay keys, and a link is verified by counting bits. A key with
    more than ``paired`` fingerprints would give the square of them in pairs: these fingerprints
    are instead listed under themselves and the 64 numbers that differ in one bit, and all under one
    number are linked to the smallest. Two fingerprints share such a number if and only if they
    differ in at most two bits, so that nothing is lost and nothing wrong is added; the rows are 65
    for each fingerprint.
    """
    keyed = written(fingerprint_keys(prints), "simhash-keys")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    counts = written(counts, "simhash-counts")
    small = keyed.join(counts.where(F.col("n") <= paired), "key").select("key", "fingerprint")
    other = small.withColumnRenamed("fingerprint", "b")
    pairs = (
        small.withColumnRenamed("fingerprint", "a")
        .join(other, "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    crowded = (
        keyed.join(counts.where(F.col("n") > paired), "key").select("fingerprint").distinct()
    )
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    around = written(
        crowded.select(
            "fingerprint",
            F.explode(
                F.concat(
                    F.array("fingerprint"),
                    F.transform(bits, lambda bit: F.col("fingerprint").bitwiseXOR(bit)),
                )
            ).alias("near"),
        ),
        "simhash-around",
    )
    first = written(
        around.groupBy("near")
        .agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z"))
        .where(F.col("a") < F.col("z"))
        .select("near", "a"),
        "simhash-first",
    )
    stars = around.join(first, "near").select("a", F.col("fingerprint").alias("b"))
    return pairs.unionByName(stars.where(F.col("a") != F.col("b"))).distinct()


def near_duplicates(
    content: DataFrame, content_id: str = "content_id", script: str = "script"
) -> DataFrame:
    """``(content_id, fingerprint, component_id)``, a row per row of ``content``.

    Fingerprints (see :func:`fingerprints`) are linked if they differ in at most two bits; the
    component is the smallest id reachable over links. Equal fingerprints are taken together before
    anything is linked, so copies cost nothing. Rows without an id have a fingerprint and take the
    component of the others that have one (NULL if none has); they connect like any other row.
    Scripts that are empty or NULL share fingerprint 0. Rows with one id count once for each
    different script. Other columns of ``content`` are left out.
    """
    prints = written(fingerprints(content, content_id, script), "simhash-prints")
    members = written(
        prints.groupBy("fingerprint").agg(F.min("content_id").alias("first")), "simhash-members"
    )
    links = close_links(members)
    components = written(connected_components(links), "simhash-components").select(
        F.col("node").alias("fingerprint"), "component"
    )
    grouped = written(
        members.join(components, "fingerprint", "left").withColumn(
            "component", F.coalesce("component", "fingerprint")
        ),
        "simhash-groups",
    )
    # The smallest id of each component that has more than one fingerprint.
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(
        grouped.join(written(smallest, "simhash-smallest"), "component").select(
            "fingerprint", "component_id"
        ),
        "simhash-named",
    )
    return prints.join(named, "fingerprint").select("content_id", "fingerprint", "component_id")


def one_of_each(
    content: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    components: Callable[[DataFrame, str, str], DataFrame] = near_duplicates,
) -> DataFrame:
    """``content`` with one item of each component (of :func:`near_duplicates`), that of smallest id.

    An id stays if it is the smallest of a component of any of its rows; rows that repeat an id
    and its script stay once. Rows without an id are never removed. Only ids are joined; no
    fingerprint is computed twice.
    """
    groups = written(components(content, content_id, script), "simhash-classes")
    ids = written(
        groups.where(F.col("content_id").isNotNull())
        .groupBy(F.col("content_id").alias("_id"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max(F.col("content_id") == F.col("component_id")).alias("_first"),
        )
        .where(~F.col("_first") | (F.col("_rows") > 1)),
        "simhash-ids",
    )
    gone = ids.where(~F.col("_first"))
    kept = content.join(gone, content[content_id] == gone["_id"], "left_anti")
    repeated = written(ids.where("_first").select("_id"), "simhash-repeated")
    if is_empty(repeated):
        return kept
    again = kept[content_id] == repeated["_id"]
    several = kept.join(repeated, again, "left_semi").dropDuplicates([content_id, script])
    return kept.join(repeated, again, "left_anti").unionByName(several)


def as_hex(value: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
