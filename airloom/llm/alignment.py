"""Scripts cut into tokens by two public tokenizers, and which tokens of either cover each other."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import written
from airloom.llm.loops import chunks

#: Scripts of so many bytes are worked on together; a longer script alone.
CHUNK_BYTES = 1 << 20
#: Pairs of tokens that are counted in a task before the counts are handed on.
COUNTED = 1 << 18
#: At most so many of the most frequent pairs are sent to every task.
FREQUENT = 1 << 18

#: What byte-level vocabularies of this kind cut texts into first. A fixed value.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEXT_A, NEXT_B = 1, 2


class ByteTokens:
    """The tokenizer of a byte-level BPE file, from the bytes of the file.

    ``encode`` puts a space before the texts. Special tokens are not looked for: their text is
    plain text. Runs on ``tiktoken`` with the file's vocabulary where that gives the same
    tokens: plain byte-level cutting, and merges in the order of the ids. Any other file runs on
    ``tokenizers``.
    """

    def __init__(self, file: bytes) -> None:
        described = json.loads(file)
        vocabulary, merges = described["model"]["vocab"], described["model"]["merges"]
        letters = _byte_letters()
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in described["added_tokens"])]))
        for text, number in vocabulary.items():
            known = all(letter in letters for letter in text)
            self.bytes[number] = bytes(letters[c] for c in text) if known else text.encode()
        cutting = described["pre_tokenizer"] or {}
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in merges)
        ids = [vocabulary["".join(pair)] for pair in pairs]
        plain = described["normalizer"] is None and (
            cutting.get("type"), cutting.get("add_prefix_space"), cutting.get("use_regex", True)
        ) == ("ByteLevel", False, True)
        single = sorted(number for text, number in vocabulary.items() if len(text) == 1)
        ordered = ids == sorted(set(ids)) and single == list(range(256)) and len(ids) + 256 == len(vocabulary)
        if plain and ordered:
            ranks = {self.bytes[number]: number for number in vocabulary.values()}
            encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [encoding.encode_ordinary(f" {text}") for text in texts]
        else:
            tokenizer = tokenizers.Tokenizer.from_str(file.decode())
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [tokenizer.encode(f" {text}", add_special_tokens=False).ids for text in texts]


class PieceTokens:
    """The tokenizer of a SentencePiece model, from the bytes of the file.

    The model itself puts the space before the texts.
    """

    def __init__(self, file: bytes) -> None:
        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.bytes = [
            bytes([int(piece[3:-1], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode()
            for number, piece in enumerate(model.id_to_piece([*range(model.get_piece_size())]))
        ]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class _Side:
    """A tokenizer, and the bytes of its tokens one after the other."""

    def __init__(self, tokens: ByteTokens | PieceTokens) -> None:
        self.encode = tokens.encode
        self.lengths = np.fromiter(map(len, tokens.bytes), np.int64, len(tokens.bytes))
        self.bytes = np.frombuffer(b"".join(tokens.bytes), np.uint8)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        found = self.encode(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def spelled(self, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Which texts the bytes of their tokens spell, with the space before."""
        lengths = self.lengths[ids]
        first = (np.cumsum(self.lengths) - self.lengths)[ids] - (np.cumsum(lengths) - lengths)
        spelled = self.bytes[np.repeat(first, lengths) + np.arange(int(lengths.sum()))]
        ends = np.cumsum(np.r_[0, lengths])[np.cumsum(counts)]
        starts = np.r_[0, ends[:-1]]
        whole = spelled.tobytes()
        return np.array(
            [whole[s:e] == b" " + text for s, e, text in zip(starts.tolist(), ends.tolist(), texts, strict=True)], bool
        )


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(b): b for b in plain} | {chr(256 + place): b for place, b in enumerate(others)}


def aligned_scripts(
    content: DataFrame,
    byte_bpe: str,
    piece_bpe: str,
    content_id: str = "content_id",
    script: str = "script",
) -> DataFrame:
    """The tokens of every script by two tokenizers, and how they meet.

    ``(row, content_id, a, b, steps, wide)``: ``a`` are the ids of a space and the script by the
    ``byte_bpe`` file, ``b`` those of the script by the ``piece_bpe`` model, which adds the space
    itself; packed, an id in two bytes, or in four where ``wide`` tells that the vocabularies are
    larger. ``steps`` has a byte per link, that is for each pair of tokens whose byte ranges overlap, in order: 1
    for the next token of ``a``, 2 for the next of ``b``, 3 for the next of both. With 3 a group
    begins: where tokens of both sides end at the same byte. ``row`` is unique.

    Each token's start looks up the token of the other side that covers it (``merge_asof`` by
    script, a chunk of scripts at a time); both directions together are the links.

    A script that is NULL or empty, or that the bytes of either side's tokens do not spell, with the
    space before, has no tokens. One row per row of ``content``, repeated rows and NULL ids
    included; other columns are ignored. Whole scripts are used, one in one task. The files are
    read where the job is set up and sent to the tasks (some MB, whatever the input).
    Written to the shared folder, as the counts and the groups both read it.
    """
    files = [open(path, "rb").read() for path in (byte_bpe, piece_bpe)]
    kind = content.schema[content_id].dataType.simpleString()
    rows = content.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(content_id).alias("id"),
        F.col(script).cast("string").cast("binary").alias("script"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Side(ByteTokens(files[0])), _Side(PieceTokens(files[1]))
        wide = any(len(side.lengths) > 1 << 16 for side in sides)
        for batch in batches:
            texts = [text or b"" for text in batch.column(2).to_pylist()]
            for start, stop in chunks([len(text) for text in texts], CHUNK_BYTES):
                part = batch.slice(start, stop - start)
                columns = [*_aligned(texts[start:stop], *sides, wide), pa.array([wide] * part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns], ["row", "id", "a", "b", "steps", "wide"]
                )

    schema = f"row bigint, id {kind}, a binary, b binary, steps binary, wide boolean"
    aligned = rows.mapInArrow(run, schema).withColumnRenamed("id", content_id)
    return written(aligned, "aligned-scripts", compression="zstd")


def _aligned(texts: list[bytes], one: _Side, other: _Side, wide: bool) -> list[pa.Array]:
    """``a``, ``b`` and ``steps`` of a chunk of scripts."""
    readable = [text.decode(errors="replace") for text in texts]
    tokens = [side.tokens(readable) for side in (one, other)]
    good = np.fromiter(map(len, texts), np.int64, len(texts)) > 0
    for side, (ids, counts) in zip((one, other), tokens, strict=True):
        good &= side.spelled(ids, counts, texts)
    tokens = [(ids[np.repeat(good, counts)], counts * good) for ids, counts in tokens]
    spans = []
    for side, (ids, counts) in zip((one, other), tokens, strict=True):
        # Both sides of a script have the same bytes, so one scale of bytes serves the whole chunk.
        at = np.cumsum(side.lengths[ids]) - side.lengths[ids]
        script = np.repeat(np.arange(len(texts)), counts)
        spans.append(pd.DataFrame({"script": script, "at": at, "token": np.arange(len(ids))}))
    covered = [
        pd.merge_asof(left, right, on="at", by="script", suffixes=("", "_covering"))
        for left, right in (spans, spans[::-1])
    ]
    # Where both start at once, both directions find the same pair.
    again = np.isin(spans[1]["at"].to_numpy(), spans[0]["at"].to_numpy(), assume_unique=True)
    only = covered[1][~again]
    order = np.argsort(np.concatenate([covered[0]["at"], only["at"]]), kind="stable")
    links = [
        np.concatenate([covered[0][x], only[y]])[order].astype(np.int64)
        for x, y in (("token", "token_covering"), ("token_covering", "token"))
    ]
    steps = np.zeros(len(order), dtype=np.uint8)
    for link, step in zip(links, (NEXT_A, NEXT_B), strict=True):
        steps[np.diff(link, prepend=-1) > 0] |= step
    n_links = np.bincount(np.concatenate([covered[0]["script"], only["script"]]), minlength=len(texts))
    kind = np.uint32 if wide else np.uint16
    return [*(_packed(ids.astype(kind), counts) for ids, counts in tokens), _packed(steps, n_links)]


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int32)


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values of each script as one binary value."""
    buffers = [None, pa.py_buffer(_offsets(counts * values.itemsize)), pa.py_buffer(values)]
    return pa.Array.from_buffers(pa.binary(), len(counts), buffers)


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many each script has."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return values.view(kind), np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(counts)), values)


class _Chunk:
    """A batch of aligned scripts as flat arrays."""

    def __init__(self, a: pa.Array, b: pa.Array, steps: pa.Array, wide: pa.Array) -> None:
        kind = np.uint32 if wide[0].as_py() else np.uint16
        (self.a, self.n_a), (self.b, self.n_b) = _unpacked(a, kind), _unpacked(b, kind)
        self.steps, self.n_links = _unpacked(steps, np.uint8)

    def links(self) -> np.ndarray:
        """The pair of ids of every link, as one number."""
        next_a, next_b = (self.steps & NEXT_A) > 0, (self.steps & NEXT_B) > 0
        a, b = self.a[np.cumsum(next_a) - 1], self.b[np.cumsum(next_b) - 1]
        return a.astype(np.int64) << 32 | b

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over the links of each script."""
        ends = np.cumsum(self.n_links)
        total = np.r_[0, np.cumsum(values)]
        return total[ends] - total[ends - self.n_links]


_TOKENS = ("a", "b", "steps", "wide")


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Chunk]]:
    """Parts of bounded size, by their links, a longer script alone. Tokens are the last columns."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.num_columns - 2)).to_pylist()
        for start, stop in chunks(sizes, CHUNK_BYTES):
            part = batch.slice(start, stop - start)
            yield part, _Chunk(*part.columns[-4:])


def link_counts(aligned: DataFrame) -> DataFrame:
    """How many links join each pair of ids, over all scripts: ``(a_id, b_id, n, best)``.

    ``best`` tells that no other pair of the same ``b_id`` has more; ties included. Counted in the
    tasks first, in stretches of bounded size, then shuffled by pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, chunk in _chunks_of(batches):
            new, n = np.unique(chunk.links(), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > COUNTED:
                yield counted(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield counted(keys, counts)

    def counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = (keys >> 32).astype(np.int32), keys.astype(np.int32), counts
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a_id", "b_id", "n"])

    parts = aligned.select(*_TOKENS).mapInArrow(run, "a_id int, b_id int, n bigint")
    pairs = written(parts.groupBy("a_id", "b_id").agg(F.sum("n").alias("n")), "link-counts")
    most = pairs.groupBy("b_id").agg(F.max("n").alias("_most"))
    return written(
        pairs.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("_most")).alias("best")),
        "link-bests",
    )


def link_strengths(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``aligned``: ``(row, n_best, count_sum)``.

    ``n_best`` counts the links whose pair is a best one of :func:`link_counts`, ``count_sum`` adds up the
    counts of all its links' pairs. The most frequent pairs, at most ``frequent``, are sent to every
    task; links of rarer pairs, if there are any, are joined to their counts.
    """
    level = _least_frequent(counts, frequent)
    known = counts.where(F.col("n") >= level).toArrow()
    keys = known.column("a_id").to_numpy().astype(np.int64) << 32 | known.column("b_id").to_numpy()
    order = np.argsort(keys)
    keys = np.r_[keys[order], np.int64(1) << 62]
    n = np.r_[known.column("n").to_numpy()[order], 0]
    best = np.r_[known.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64), 0]

    def places(links: np.ndarray) -> np.ndarray:
        place = np.searchsorted(keys, links)
        return np.where(keys[place] == links, place, len(keys) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in _chunks_of(batches):
            place = places(chunk.links())
            sums = [pa.array(chunk.sums(values[place])) for values in (best, n)]
            yield pa.RecordBatch.from_arrays([part.column(0), *sums], ["row", "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in _chunks_of(batches):
            links = chunk.links()
            missed = np.flatnonzero(places(links) == len(keys) - 1)
            rows = np.repeat(part.column(0).to_numpy(), chunk.n_links)[missed]
            ids = (links[missed] >> 32).astype(np.int32), links[missed].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, *ids)], ["row", "a_id", "b_id"])

    rows = aligned.select("row", *_TOKENS)
    sums = rows.mapInArrow(run, "row bigint, n_best bigint, count_sum bigint")
    others = counts.where(F.col("n") < level)
    if others.isEmpty():
        return sums
    links = rows.mapInArrow(rare, "row bigint, a_id int, b_id int").groupBy("row", "a_id", "b_id")
    links = links.agg(F.count(F.lit(1)).alias("_links")).join(others, ["a_id", "b_id"])
    more = links.select(
        "row",
        F.when(F.col("best"), F.col("_links")).otherwise(F.lit(0).cast("bigint")).alias("n_best"),
        (F.col("n") * F.col("_links")).alias("count_sum"),
    )
    return sums.unionByName(more).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )


def _least_frequent(counts: DataFrame, frequent: int) -> int:
    """The least power of two that at most so many pairs reach; one row a power comes to the driver."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    total, least = 0, 1 << 62
    for row in counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():
        total += row["count"]
        if total > frequent:
            break
        least = 1 << row.power
    return least


def token_groups(aligned: DataFrame, content_id: str = "content_id") -> DataFrame:
    """Per row of ``aligned``: ``(row, content_id, n_a, n_b, n_links, n_groups, groups)``.

    ``groups`` lists the ids of either side between the bytes where tokens of both end, as
    ``a1,a2|b1;a3|b2,b3``; empty without tokens.
    """

    kind = aligned.schema[content_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in _chunks_of(batches):
            both = chunk.steps == (NEXT_A | NEXT_B)
            sides = []
            for ids, step in ((chunk.a, NEXT_A), (chunk.b, NEXT_B)):
                begun = np.cumsum((chunk.steps & step) > 0)[both] - 1
                sizes = np.diff(np.r_[begun, len(ids)])
                sides.append(pc.binary_join(_lists(pa.array(ids).cast(pa.string()), sizes), ","))
            n_groups = chunk.sums(both.astype(np.int64))
            groups = pc.binary_join(_lists(pc.binary_join_element_wise(*sides, "|"), n_groups), ";")
            numbers = [pa.array(x) for x in (chunk.n_a, chunk.n_b, chunk.n_links, n_groups)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *numbers, groups],
                ["row", "id", "n_a", "n_b", "n_links", "n_groups", "groups"],
            )

    schema = f"row bigint, id {kind}, n_a bigint, n_b bigint, n_links bigint, n_groups bigint, groups string"
    rows = aligned.select("row", content_id, *_TOKENS)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", content_id)
