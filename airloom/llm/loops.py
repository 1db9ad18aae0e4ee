"""Loops in content scripts: stretches of words that repeat with a period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A loop has so many words at least, and goes through its period so many times.
LEAST_WORDS, LEAST_TURNS = 24, 3
#: Scripts of so many bytes are worked on together; a longer script alone.
CHUNK_BYTES = 4 << 20

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_DDL = "struct<start: bigint, length: bigint, period: bigint>"


def script_loops(content: DataFrame, content_id: str = "content_id", script: str = "script") -> DataFrame:
    """The loops of every script: ``(content_id, n_words, loops, strongest, collapsed)``.

    Words stand between ASCII white space and are numbered from 0. A loop is a stretch of words
    with smallest period ``p`` (words ``p`` apart are equal) that has at least 24 words and ``3 p``,
    and goes on as far as the period does on both sides. ``loops`` has ``(start, length, period)``
    of all, by start and then period; they may overlap. ``strongest`` is the one of greatest
    length/period, compared exactly, ties by start and then period; NULL if there is none.
    ``collapsed`` is the script with every word dropped that some loop has after its first period,
    the words that stay being joined by one space.

    One row per row of ``content``, repeated rows and NULL ids included; other columns are ignored.
    A NULL or blank script has no words, no loops and an empty ``collapsed``. Whole scripts are
    searched, however long; a script is worked on in one task, in memory of some 100 bytes a word.
    """
    rows = content.select(F.col(content_id), F.col(script).cast("string").cast("binary").alias("_script"))
    kind = content.schema[content_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in chunks([len(text or b"") for text in texts]):
                found = [*loops_of([(text or b"").split() for text in texts[start:stop]])]
                n_words, loops, strongest, collapsed = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array(n_words, pa.int64()),
                        pa.array([[*map(_named, x)] for x in loops], pa.list_(_RUN)),
                        pa.array([x and _named(x) for x in strongest], _RUN),
                        pa.array(collapsed, pa.binary()),
                    ],
                    ["id", "n_words", "loops", "strongest", "collapsed"],
                )

    schema = f"id {kind}, n_words bigint, loops array<{_RUN_DDL}>, strongest {_RUN_DDL}, collapsed binary"
    return rows.mapInArrow(run, schema).select(
        F.col("id").alias(content_id), "n_words", "loops", "strongest", F.col("collapsed").cast("string")
    )


def _named(loop: tuple[int, int, int]) -> dict[str, int]:
    return dict(zip(("start", "length", "period"), loop, strict=True))


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a sequence into stretches of at most so many bytes, or one entry."""
    start, total = 0, 0
    for place, size in enumerate(sizes):
        if place > start and total + size > most:
            yield start, place
            start, total = place, 0
        total += size
    if sizes:
        yield start, len(sizes)


def loops_of(scripts: list[list[bytes]]) -> Iterator[tuple[int, list, tuple | None, bytes]]:
    """For each list of words: their number, the loops, the strongest loop and the collapsed script."""
    counts = np.array([len(words) for words in scripts], dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    numbers: dict[bytes, int] = {}
    word = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for words in scripts for w in words), np.int64, int(counts.sum())
    )
    # A word of one script is never that of another.
    word += np.repeat(np.arange(len(scripts)) * len(numbers), counts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in scripts]
    for start, length, period in _runs(word, int(counts.max(initial=0))):
        script = int(np.searchsorted(firsts, start, side="right")) - 1
        while not counts[script]:  # scripts without words start where the next one does
            script -= 1
        found[script].append((start - int(firsts[script]), length, period))
    for words, loops in zip(scripts, found, strict=True):
        loops.sort(key=lambda loop: (loop[0], loop[2]))
        strongest = None
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in loops:
            if strongest is None or length * strongest[2] > strongest[1] * period:
                strongest = start, length, period
            kept[start + period : start + length] = False
        stay = [w for w, k in zip(words, kept.tolist(), strict=True) if k] if loops else words
        yield len(words), loops, strongest, b" ".join(stay)


def _runs(word: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All loops ``(start, length, period)`` by a dictionary of basic factors.

    The factors are the stretches of 1, 2, 4 and so on words. Each gets a number, equal stretches
    the same one, from the numbers of its two halves; one that stands only once has no
    number, nor has a longer one with it. From a factor of ``width`` words to the next equal one
    within ``2 * width`` it is a possible period, and neighbouring places with the same distance
    make up a stretch of that period.

    None is missed: let ``width`` be the least power of two not below a period ``p``. Inside a
    loop, a factor of ``width >= p`` words next stands ``p`` words on, not nearer, as the turns
    of a shortest period all differ; and ``p + width < 3 p``, so the loop has such a pair. A
    multiple of ``p`` may be proposed too: for the same stretch, of which the smallest period counts.
    """
    at, name, width = np.arange(len(word)), word, 1
    proposed: set[tuple[int, int, int]] = set()
    while len(at) and width < longest:
        order = np.argsort(name, kind="stable")  # places in order within a number
        same = name[order][1:] == name[order][:-1]
        distance = np.zeros(len(at), dtype=np.int64)
        distance[order[:-1][same]] = np.diff(at[order])[same]
        near = np.flatnonzero((distance > 0) & (distance <= 2 * width))
        if len(near):
            place, period = at[near], distance[near]
            begins = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(period) != 0)])
            places = np.diff(np.r_[begins, len(place)])
            start, period = place[begins], period[begins]
            length = places - 1 + width + period
            enough = length >= np.maximum(LEAST_WORDS, LEAST_TURNS * period)
            proposed.update(zip(start[enough].tolist(), length[enough].tolist(), period[enough].tolist(), strict=True))
        again = np.zeros(len(at), dtype=bool)
        again[order[:-1][same]] = True
        again[order[1:][same]] = True
        number = np.empty(len(at), dtype=np.int64)
        number[order] = np.cumsum(np.r_[1, ~same]) if len(order) else order
        at, number = at[again], number[again]
        other = np.searchsorted(at, at + width)
        whole = other < len(at)
        whole[whole] = at[other[whole]] == at[whole] + width
        name = number[whole] * (len(word) + 1) + number[other[whole]]
        at, width = at[whole], 2 * width
    shortest: dict[tuple[int, int], int] = {}
    for start, length, period in proposed:
        ends = _extended(word, start, start + length, period)
        shortest[ends] = min(period, shortest.get(ends, period))
    return [(start, end - start, period) for (start, end), period in shortest.items()]


def _extended(word: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """How far words ``period`` apart stay equal on both sides."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(word[low:start] != word[low + period : start + period])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    step = 64
    while end < len(word):
        high = min(len(word), end + step)
        differ = np.flatnonzero(word[end:high] != word[end - period : high - period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = high, 2 * step
    return start, end
