"""Source excerpts that leaked into scripts, found by a distributed positional inverted index."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import written

WIDTH = 13
ANCHORS = 3
ANCHORS_AT_ONCE = 1_000_000
ROWS_AT_ONCE = 20_000
TERM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: Column) -> Column:
    """Terms: runs of ASCII letters (A-Z lower-cased), digits and all other characters above 0x7F."""
    low = F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return F.filter(F.split(low, TERM_GAP), lambda term: term != "")


@dataclass(frozen=True)
class LeakIndex:
    """``windows``: the excerpts' windows ``(window, length, anchors)``; ``sources``: ``(window,
    source_id)``; ``documents``: ``(content_id, doc, n_words)``, a row per script; ``postings``:
    ``(term, doc, pos, context, before)`` of the anchors. ``doc`` is the script's MD5, so that copies
    are indexed once. ``context`` holds the terms around a place where the term is the rarest of some
    window, ``before`` of them before it.
    """

    windows: DataFrame
    sources: DataFrame
    documents: DataFrame
    postings: DataFrame


def term_counts(content: DataFrame, script: str) -> DataFrame:
    """``(term, n)``: how often each term occurs, summed up in every batch; sums are still to merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in batch.column(0):
                if text.is_valid:
                    counts.update(_TERM.findall(text.as_buffer().to_pybytes().lower()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts.keys()), pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["term", "n"],
            )

    return content.select(F.col(script).cast("string")).mapInArrow(run, "term string, n bigint")


def build_index(
    content: DataFrame,
    excerpts: DataFrame,
    content_id: str,
    script: str,
    source_id: str,
    excerpt: str,
    width: int = WIDTH,
) -> LeakIndex:
    """Index the scripts under the rarest terms of every excerpt window.

    Terms are counted over all scripts. A window with a term that no script has cannot occur and
    is left out; of the others the three rarest terms become anchors, and all places of anchors in
    all scripts are stored.
    """
    items = excerpts.select(
        F.col(source_id).cast("string").alias("source_id"), terms_of(F.col(excerpt)).alias("terms")
    ).where(F.size("terms") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - width + 1, F.lit(1)))
    cut = items.select("source_id", "terms", F.explode(starts).alias("at")).select(
        "source_id", F.concat_ws(" ", F.slice("terms", F.col("at"), width)).alias("window")
    )
    sources = written(cut.distinct(), "leak-sources")
    places = F.posexplode(F.split("window", " ")).alias("offset", "term")
    windows = sources.select("window").distinct()
    vocabulary = written(windows.select(places).select("term").distinct(), "leak-terms")
    counts = written(
        term_counts(content, script)
        .join(vocabulary, "term")
        .groupBy("term")
        .agg(F.sum("n").alias("n")),
        "leak-counts",
    )
    ordered = F.sort_array(F.collect_list(F.struct("n", "offset", "term")))
    ranked = written(
        windows.select("window", places)
        .join(counts, "term", "left")
        .groupBy("window")
        .agg(ordered.alias("all"), F.count("n").alias("known"))
        .where(F.col("known") == F.size("all"))
        .select("window", F.size("all").alias("length"), F.slice("all", 1, ANCHORS).alias("anchors")),
        "leak-windows",
    )
    number = F.col("number")
    anchors = written(
        ranked.select(F.posexplode("anchors").alias("number", "a"))
        .groupBy(F.col("a.term").alias("term"))
        .agg((F.min(number) == 0).alias("rarest")),
        "leak-anchors",
    )
    blocks = -(-anchors.count() // ANCHORS_AT_ONCE)
    index = None
    for block in range(max(1, blocks)):
        part = anchors.where(F.pmod(F.xxhash64("term"), F.lit(max(1, blocks))) == block)
        places = _scan(content, content_id, script, {r.term: r.rarest for r in part.collect()}, width, not block)
        index = places if index is None else index.unionByName(places)
    index = written(index, "leak-index")
    return LeakIndex(
        ranked,
        sources,
        index.where(F.col("term").isNull()).select("content_id", "doc", F.col("pos").alias("n_words")),
        written(
            index.where(F.col("term").isNotNull())
            .select("term", "doc", "pos", "context", "before")
            .distinct(),
            "leak-postings",
        ),
    )


def _scan(
    content: DataFrame,
    content_id: str,
    script: str,
    anchors: dict[str, bool],
    width: int,
    documents: bool,
) -> DataFrame:
    """A row for every place of an anchor and, if wanted, one for each script with its length.

    ``anchors`` are at most about ``ANCHORS_AT_ONCE`` terms, and whether they are rarest in a window.
    """
    kind = content.select(content_id).schema[0].dataType
    known = {term.encode(): rarest for term, rarest in anchors.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                terms = _TERM.findall(data.lower())
                doc = hashlib.md5(data).hexdigest()
                if documents:
                    rows.append((id_.as_py(), None, doc, len(terms), None, None))
                for pos in [i for i, term in enumerate(terms) if term in known]:
                    around, before = None, None
                    if known[terms[pos]]:
                        before = min(pos, width - 1)
                        around = b" ".join(terms[pos - before : pos + width])
                    rows.append((None, terms[pos], doc, pos, around, before))
                if len(rows) > ROWS_AT_ONCE:
                    yield batch_of(rows, batch.column(0).type)
                    rows = []
            if rows:
                yield batch_of(rows, batch.column(0).type)

    def batch_of(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
        id_, term, doc, pos, around, before = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(id_, ids), text(term), pa.array(doc), pa.array(pos, pa.int64()),
                text(around), pa.array(before, pa.int32()),
            ],
            ["content_id", "term", "doc", "pos", "context", "before"],
        )

    return content.select(F.col(content_id), F.col(script).cast("string")).mapInArrow(
        run,
        f"content_id {kind.simpleString()}, term string, doc string, pos bigint, context string, "
        "before int",
    )


def phrase_matches(index: LeakIndex) -> DataFrame:
    """``(doc, start, length, window)`` for every occurrence of a window in a script.

    The places of the rarest anchor, moved back by its offset, are intersected with those of the
    next rarest, and so on; what is left is compared with the terms around the rarest, word by word.
    """
    kept = ["window", "length", "anchors", "doc", "start", "context", "before"]
    first = F.get("anchors", F.lit(0))
    found = (
        index.windows.withColumn("term", first["term"])
        .join(index.postings, "term")
        .withColumn("start", F.col("pos") - first["offset"])
        .where(F.col("start") >= 0)
        .select(*kept)
    )
    places = index.postings.select("term", "doc", "pos")
    for number in range(1, ANCHORS):
        anchor = F.get("anchors", F.lit(number))
        wanted = found.where(F.size("anchors") > number).withColumns(
            {"term": anchor["term"], "pos": F.col("start") + anchor["offset"]}
        )
        met = wanted.join(places, ["term", "doc", "pos"]).select(*kept)
        found = met.unionByName(found.where(F.size("anchors") <= number))
    at = F.col("before") - first["offset"] + 1
    there = F.concat_ws(" ", F.slice(F.split("context", " "), at, F.col("length")))
    # A start before the context's would be one before the script's.
    return found.where((at >= 1) & (there == F.col("window"))).select("doc", "start", "length", "window")


def proximity_matches(index: LeakIndex, slop: int) -> DataFrame:
    """``(doc, source_id)`` where the anchors of a window stand within ``slop`` of their places.

    Places are compared by cells of ``slop + 1`` positions and their neighbours.
    """
    cell = F.floor(F.col("pos") / F.lit(slop + 1))
    cells = index.postings.withColumn("cell", cell).withColumnRenamed("pos", "found")
    near = index.windows.withColumn("term", F.get("anchors", F.lit(0))["term"]).join(
        index.postings, "term"
    )
    near = near.withColumn("start", F.col("pos") - F.get("anchors", F.lit(0))["offset"])
    near = near.select("window", "anchors", "doc", "start")
    for number in range(1, ANCHORS):
        anchor = F.get("anchors", F.lit(number))
        wanted = near.where(F.size("anchors") > number).withColumns(
            {"term": anchor["term"], "pos": F.col("start") + anchor["offset"]}
        )
        around = wanted.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        met = around.join(cells, ["term", "doc", "cell"]).where(
            F.abs(F.col("found") - F.col("pos")) <= slop
        )
        near = (
            met.select("window", "anchors", "doc", "start")
            .distinct()
            .unionByName(near.where(F.size("anchors") <= number))
        )
    return near.join(index.sources, "window").select("doc", "source_id").distinct()


def leaked_excerpts(
    content: DataFrame,
    excerpts: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    source_id: str = "source_id",
    excerpt: str = "excerpt",
    width: int = WIDTH,
) -> DataFrame:
    """How much of each script is verbatim source excerpt.

    ``(content_id, doc, n_words, n_hit, source_ids, leaked)``, a row per row of ``content``:
    ``n_hit`` counts the words inside any occurrence of ``width`` words in a row of an excerpt (of a
    shorter one, all of it), ``source_ids`` are the excerpts found, as text in order, and a script is
    ``leaked`` if at least a twentieth of its words are hit. ``doc`` is the MD5 of the script.

    The scripts are read twice, to count terms and to store the places of anchors, and never
    shuffled. NULL and empty scripts have no words, and NULL or
    empty excerpts no windows; an excerpt without an id is hit, but not named. Rows with equal
    ids are counted each for itself. Other columns are left out.
    """
    index = build_index(content, excerpts, content_id, script, source_id, excerpt, width)
    matches = written(phrase_matches(index).distinct(), "leak-matches")
    words = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    hits = (
        matches.select("doc", words.alias("pos"))
        .distinct()
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        matches.select("doc", "window")
        .distinct()
        .join(index.sources, "window")
        .groupBy("doc")
        .agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"))
    )
    leaks = written(hits.join(named, "doc"), "leak-hits")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return index.documents.join(leaks, "doc", "left").select(
        "content_id",
        "doc",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("leaked"),
    )


def without_leaks(
    content: DataFrame,
    excerpts: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    source_id: str = "source_id",
    excerpt: str = "excerpt",
    width: int = WIDTH,
) -> DataFrame:
    """``content`` without the items whose script :func:`leaked_excerpts` finds leaked."""
    found = leaked_excerpts(content, excerpts, content_id, script, source_id, excerpt, width)
    leaked = written(found.where("leaked").select(F.col("doc").alias("_doc")).distinct(), "leaked")
    same = F.md5(F.coalesce(content[script], F.lit(""))) == leaked["_doc"]
    return content.join(leaked, same, "left_anti")
