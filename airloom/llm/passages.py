"""Passages that repeat word by word anywhere in the scripts, whatever their line ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import dropped, is_empty, rewritten, written
from airloom.llm.paragraphs import hashed

WORDS = 50
#: A window is found by the least hash of its runs of so many words.
RUN = 25
BASE = 0x9E3779B97F4A7C15
BATCH_ROWS = 1 << 16
ROW = "pos int, line int, start bigint, end bigint, own struct<pos:int,line:int,start:bigint>"


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return values ^ (values >> np.uint64(29))


def _polynomials(hashes: np.ndarray, width: int) -> np.ndarray:
    """A number for every run of ``width`` words: a polynomial in an odd base modulo 2**64."""
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    done = 0
    # Runs of doubling length, put together to the width.
    part, length = hashes, 1
    while length <= width:
        if width & length:
            total = total * np.uint64(pow(BASE, length, 1 << 64)) + part[done : done + len(total)]
            done += length
        if 2 * length > width:
            break
        part = part[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + part[length:]
        length *= 2
    return total


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    length = 1
    least = values
    while 2 * length <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    rest = width - length
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _words(text: str | None) -> tuple[list[bytes], bytes]:
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return data.split(), data


def _key(words: list[bytes]) -> int:
    value = xxhash.xxh3_64_intdigest(b" ".join(words))
    return value - (1 << 64) if value >> 63 else value


def _places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(line, first character, end)`` of every word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    characters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    return lines[starts], characters[starts], characters[ends]


def _span(data: bytes) -> tuple[int, int, int]:
    """``(line, first character, end)`` from the first word to the last."""
    begin, end = len(data) - len(data.lstrip()), len(data.rstrip())
    first = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    return data.count(b"\n", 0, begin), int(np.count_nonzero(first[:begin])), int(np.count_nonzero(first[:end]))


def _hashes(found: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window its hash, and its anchor, the least hash of its runs: equal windows have equal ones."""
    run = min(RUN, words)
    single = hashed(found)
    part = _polynomials(single, run)
    if words == 2 * run:
        whole = part[:-run] * np.uint64(pow(BASE, run, 1 << 64)) + part[run:]
    else:
        whole = _polynomials(single, words)
    return _mixed(whole), _least(_mixed(part), words - run + 1)


def _texts(content: DataFrame, content_id: str, script: str, words: int) -> DataFrame:
    """``(content_id, print, key, n_words, line, start, end, anchors)`` of the scripts with a window.

    ``print`` is Spark's hash of the text as it is, ``key`` that of its words.
    """
    kind = content.select(content_id).schema[0].dataType.simpleString()
    names = ["content_id", "print", "key", "n_words", "line", "start", "end", "anchors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                found, data = _words(text.as_py())
                if len(found) < words:
                    continue
                hashes, anchors = _hashes(found, words)
                kept = np.unique(anchors)
                ordered = np.sort(hashes)
                if (ordered[1:] == ordered[:-1]).any():
                    # Once for the text, and again for windows that it has twice itself.
                    _, at = np.unique(hashes, return_index=True)
                    kept = np.concatenate((kept, np.unique(np.delete(anchors, at))))
                rows.append((i, _key(found), len(found), *_span(data), kept.view(np.int64)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())),
                        batch.column(2).take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.int32()),
                        pa.array(columns[4], pa.int64()),
                        pa.array(columns[5], pa.int64()),
                        pa.array(list(columns[6]), pa.list_(pa.int64())),
                    ],
                    names,
                )

    text = F.col(script).cast("string")
    return content.select(F.col(content_id), text, F.xxhash64(text)).mapInArrow(
        run,
        f"content_id {kind}, print bigint, key bigint, n_words int, line int, start bigint, end bigint, "
        "anchors array<bigint>",
    )


def _windows(wanted: DataFrame, words: int) -> DataFrame:
    """A row per window that has one of the anchors ``wanted`` of its text."""
    kind = wanted.schema["content_id"].dataType.simpleString()
    place = pa.struct([("pos", pa.int32()), ("line", pa.int32()), ("start", pa.int64())])
    names = ["content_id", "key", "copies", "hash", "pos", "line", "start", "end", "own"]

    def batch_of(batch: pa.RecordBatch, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        i, value, pos, line, start, end, over, own_pos, own_line, own_start = map(np.concatenate, zip(*parts, strict=True))
        own = pa.StructArray.from_arrays(
            [pa.array(own_pos, pa.int32()), pa.array(own_line, pa.int32()), pa.array(own_start, pa.int64())],
            fields=list(place),
            mask=pa.array(~over),
        )
        rows = pa.array(i)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows),
                batch.column(2).take(rows),
                batch.column(3).take(rows),
                pa.array(value.view(np.int64)),
                pa.array(pos, pa.int32()),
                pa.array(line, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(end, pa.int64()),
                own,
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], 0
            for i in range(batch.num_rows):
                found, data = _words(batch.column(1)[i].as_py())
                if len(found) < words or _key(found) != batch.column(2)[i].as_py():
                    continue
                hashes, of_windows = _hashes(found, words)
                anchors = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(np.isin(of_windows.view(np.int64), anchors))
                value = hashes[hit]
                lines, starts, ends = _places(data)
                # A window that overlaps its first place in this text repeats only what comes after it.
                _, at, group = np.unique(value, return_index=True, return_inverse=True)
                first = hit[at[group]]
                over = (first < hit) & (hit - first < words)
                after = np.where(over, first + words, 0)
                # Texts with few windows share a batch, one with many is cut.
                for begin in range(0, len(hit), BATCH_ROWS):
                    part = slice(begin, begin + BATCH_ROWS)
                    at_words, own = hit[part], after[part]
                    parts.append(
                        (
                            np.full(len(at_words), i), value[part], at_words, lines[at_words], starts[at_words],
                            ends[at_words + words - 1], over[part], own, lines[own], starts[own],
                        )
                    )
                    rows += len(at_words)
                    if rows >= BATCH_ROWS:
                        yield batch_of(batch, parts)
                        parts, rows = [], 0
            if parts:
                yield batch_of(batch, parts)

    return wanted.mapInArrow(
        run, f"content_id {kind}, key bigint, copies bigint, hash bigint, {ROW}"
    )


def repeated_passages(
    content: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    words: int = WORDS,
) -> DataFrame:
    """Every passage of ``words`` words or more that also stands elsewhere, word by word.

    ``(content_id, paragraph, start, length, n_words, class_content_id, class_paragraph,
    n_paragraphs, removed)``: ``paragraph`` is the line in which a passage starts, ``start`` its first
    character and ``length`` its characters; it may start and end within lines and go over many. The
    class is named by the place at which the passage's first window stands first, in order of id
    and place; that place is itself a row that is not ``removed``. ``n_paragraphs`` is the most places
    that a window of the passage has.

    Words are as in :mod:`airloom.llm.paragraphs`. A word is in a removed passage if and only if a
    window of ``words`` words around it stands at an earlier place, so nothing is estimated: equal
    windows have the same least hash among their runs of 25 words, of which there is about one for
    13 words, and only the windows below those that occur more than once are listed. What overlaps
    its own first place is cut after it. Scripts of equal words are one text from the start, and
    their copies one passage each. Windows are told apart by 64-bit hashes.
    """
    texts = written(_texts(content, content_id, script, words), "passage-texts")
    groups = written(
        texts.groupBy("key").agg(
            F.min(F.struct("content_id", "line", "start")).alias("first"), F.count(F.lit(1)).alias("n")
        ),
        "passage-groups",
    )
    copies = written(
        texts.select("content_id", "key", "n_words", "line", "start", "end")
        .join(groups.where("n > 1"), "key")
        .select(
            "content_id",
            F.col("line").alias("paragraph"),
            "start",
            (F.col("end") - F.col("start")).alias("length"),
            F.col("n_words").cast("bigint").alias("n_words"),
            F.col("first.content_id").alias("class_content_id"),
            F.col("first.line").alias("class_paragraph"),
            F.col("n").alias("n_paragraphs"),
            (~F.col("content_id").eqNullSafe(F.col("first.content_id"))).alias("removed"),
        ),
        "passage-copies",
    )
    # One row for each different text.
    first_rows = texts.join(groups, "key").where(
        F.col("content_id").eqNullSafe(F.col("first.content_id"))
    )
    single = written(
        first_rows.groupBy("content_id", "key", "n").agg(
            F.min("print").alias("print"), F.min("anchors").alias("anchors"), F.count(F.lit(1)).alias("rows")
        ),
        "passage-single",
    )
    dropped(texts, groups)
    anchors = single.select("content_id", "print", "key", "n", F.explode("anchors").alias("anchor"))
    often = written(
        anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("anchor"),
        "passage-anchors",
    )
    wanted = written(
        anchors.join(often, "anchor", "left_semi")
        .groupBy("content_id", "print", "key", "n")
        .agg(F.collect_set("anchor").alias("anchors")),
        "passage-wanted",
    )
    dropped(often)
    text = F.col(script).cast("string")
    source = content.select(F.col(content_id).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_print"))
    # Texts under one id, or none, are told apart by their hash, so each meets its own row only.
    same = source["_id"].eqNullSafe(wanted["content_id"]) & (source["_print"] == wanted["print"])
    found = _windows(source.join(wanted, same).select("content_id", "_text", "key", "n", "anchors"), words)
    if not is_empty(single.where("rows > 1")):
        found = found.distinct()
    found = written(found, "passage-windows")
    dropped(single, wanted)
    place = F.struct("content_id", "key", "pos", "line")
    met = written(
        found.groupBy("hash")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places"), F.sum("copies").alias("n"))
        .where("places > 1")
        .select("hash", "first", "n"),
        "passage-met",
    )
    inside = F.col("content_id").eqNullSafe(F.col("first.content_id")) & (
        F.col("key") == F.col("first.key")
    )
    own = inside & F.col("own").isNotNull()
    listed = written(
        found.join(met, "hash").select(
            "content_id",
            "key",
            "pos",
            F.when(own, F.col("own")).otherwise(F.struct("pos", "line", "start")).alias("begin"),
            "end",
            (~(inside & (F.col("pos") == F.col("first.pos")))).alias("removed"),
            F.col("first.content_id").alias("class_content_id"),
            F.col("first.line").alias("class_paragraph"),
            "n",
        ),
        "passage-listed",
    )
    dropped(found, met)
    order = Window.partitionBy("content_id", "key", "removed").orderBy("pos")
    passages = (
        listed.withColumn("run", F.col("pos") - F.row_number().over(order))
        .groupBy("content_id", "key", "removed", "run")
        .agg(
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            F.max("pos").alias("last"),
            F.min_by(F.struct("class_content_id", "class_paragraph"), "pos").alias("class"),
            F.max("n").alias("n_paragraphs"),
        )
        .select(
            "content_id",
            F.col("begin.line").alias("paragraph"),
            F.col("begin.start").alias("start"),
            (F.col("end") - F.col("begin.start")).alias("length"),
            (F.col("last") + words - F.col("begin.pos")).cast("bigint").alias("n_words"),
            F.col("class.class_content_id").alias("class_content_id"),
            F.col("class.class_paragraph").alias("class_paragraph"),
            "n_paragraphs",
            "removed",
        )
    )
    return passages.unionByName(copies)


def without_passages(
    content: DataFrame, passages: DataFrame, content_id: str = "content_id", script: str = "script"
) -> DataFrame:
    """``content`` with the removed passages of :func:`repeated_passages` cut from the scripts.

    Rows without an id keep their scripts as they are, and so do NULL scripts. Columns may have any names.
    """
    cuts = written(
        passages.where("removed")
        .groupBy(F.col("content_id").alias("_id"))
        .agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("_cuts")),
        "passage-cuts",
    )
    text = F.col("_script")
    # Passages may overlap: what is kept starts after the furthest end so far.
    state = F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at"))
    kept = F.aggregate(
        "_cuts",
        state,
        lambda done, cut: F.struct(
            F.concat(
                done["kept"],
                F.substring(text, (done["at"] + 1).cast("int"), F.greatest(cut["start"] - done["at"], F.lit(0)).cast("int")),
            ).alias("kept"),
            F.greatest(done["at"], cut["end"]).alias("at"),
        ),
        lambda done: F.concat(
            done["kept"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
        ),
    )
    return rewritten(
        content, cuts, content_id, script, F.when(F.col("_cuts").isNull(), text).otherwise(kept)
    )
