"""Near copies of whole scripts: SimHash groups joined with exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm import paragraphs
from airloom.llm.common import dropped, written
from airloom.llm.components import connected_components
from airloom.llm.simhash import _signed, close_links, fingerprint


def _whole(text: str | None, min_words: int) -> Iterator[tuple[int, int, list[bytes]]]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if words:
        yield 0, 0, words


def _prints(content: DataFrame, content_id: str, script: str) -> DataFrame:
    """``(content_id, fingerprint, key)``, a row per row; the key as in the paragraph bands."""
    kind = content.select(content_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py() for text in batch.column(1)]
            keys = [paragraphs._key(words) for t in texts for _, _, words in list(_whole(t, 1)) or [(0, 0, [])]]
            prints = [_signed(fingerprint(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64()), pa.array(keys, pa.int64())],
                ["content_id", "fingerprint", "key"],
            )

    return content.select(F.col(content_id), F.col(script).cast("string")).mapInArrow(
        run, f"content_id {kind}, fingerprint bigint, key bigint"
    )


def near_copies(
    content: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    similarity: float = paragraphs.SIMILARITY,
) -> DataFrame:
    """``(content_id, component_id)``, a row per row of ``content``.

    Two scripts are linked if their fingerprints differ in at most two bits, as in
    :func:`airloom.llm.simhash.near_duplicates`, or if the Jaccard similarity of their shingles of five
    words is ``similarity`` or more. SimHash cannot reach the second kind (at 0.8 fingerprints differ in
    up to 11 bits), so its candidates come from MinHash bands that find a pair at the threshold with
    probability 0.999; they are verified exactly. The component is the smallest id reachable.
    """
    prints = written(_prints(content, content_id, script), "near-prints")
    members = written(prints.select("fingerprint").distinct(), "near-members")
    alike = written(connected_components(close_links(members)), "near-alike").select(
        F.col("node").alias("fingerprint"), F.col("component").alias("alike")
    )
    rows = paragraphs.band_rows(similarity, paragraphs.HASHES, paragraphs.RECALL)
    found = written(
        paragraphs.paragraph_bands(content, content_id, script, 1, rows, _whole), "near-bands"
    )
    classes = paragraphs.linked(found, content, script, similarity, 1, paragraphs.PAIRED, _whole)
    dropped(found, members)
    texts = written(
        prints.groupBy("fingerprint", "key")
        .agg(F.min("content_id").alias("first"))
        .join(alike, "fingerprint", "left")
        .join(classes, "key", "left")
        .select(
            "fingerprint", "key", "first",
            F.xxhash64(F.lit("f"), F.coalesce("alike", "fingerprint")).alias("a"),
            F.xxhash64(F.lit("k"), F.coalesce("class", "key")).alias("b"),
        ),
        "near-texts",
    )
    components = written(connected_components(texts.select("a", "b")), "near-components")
    grouped = written(
        texts.join(components.withColumnRenamed("node", "a"), "a").select("fingerprint", "key", "first", "component"),
        "near-groups",
    )
    smallest = written(
        grouped.groupBy("component").agg(F.min("first").alias("component_id")), "near-smallest"
    )
    named = written(
        grouped.join(smallest, "component").select("fingerprint", "key", "component_id"), "near-named"
    )
    return prints.join(named, ["fingerprint", "key"]).select("content_id", "component_id")
