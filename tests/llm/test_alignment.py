"""Aligned tokens against a walk over both sides, and the counts against plain sums."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from airloom.llm import alignment
from airloom.llm.queries import QUERIES, TOKENIZERS

BYTE_BPE, PIECE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
KIND = "content_id long, script string"
ODD = [
    (1, "Hello wörld, 你好 🙂 it's 12345 o'clock"), (1, "Hello wörld, 你好 🙂 it's 12345 o'clock"), (2, None), (3, ""),
    (None, "no id"), (4, "special <|endoftext|> and <s> </s> <unk> <0x41>"), (5, "low ▁ line"), (6, "  two  spaces \n\n\t x "),
    (7, "zero \x00 byte"), (8, "  odd　spaces‍"), (9, " "), (10, "long " * 40_000), (11, "é" * 5000),
]


def byte_of(letter):
    """The byte of a letter of the byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return ord(letter) if ord(letter) < 256 else others[ord(letter) - 256]


def plain(texts):
    """Per text the ids of both sides, the groups and the links, by walking along both."""
    a_side = tokenizers.Tokenizer.from_file(BYTE_BPE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_text = {number: text for text, number in a_side.get_vocab().items()}

    def b_bytes(number):
        piece = b_side.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(number) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        spelled = [[bytes(map(byte_of, a_text[i])) for i in a], [b_bytes(i) for i in b]]
        if text and not all(b"".join(side) == f" {text}".encode() for side in spelled):
            a, b, spelled = [], [], [[], []]
        ends = []
        for side in spelled:
            total, at = 0, []
            for token in side:
                total += len(token)
                at.append(total)
            ends.append(at)
        i = j = 0
        links, groups, group = [], [], ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = ends[0][i], ends[1][j]
            if end_a <= end_b:
                group[0].append(a[i])
                i += 1
            if end_b <= end_a:
                group[1].append(b[j])
                j += 1
            if end_a == end_b:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
        found.append((a, b, ";".join(groups), len(groups), links))
    return found


def figures(rows):
    """What the query returns for each row."""
    found = plain([text for _, text in rows])
    counts = Counter(link for *_, links in found for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (
            item, len(a), len(b), n, len(links), sum(counts[x] == most[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for (item, _), (a, b, groups, n, links) in zip(rows, found, strict=True)
    ]


def digests(aligned, strengths):
    groups = alignment.token_groups(aligned).join(strengths, "row")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    names = ["content_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return sorted((tuple(r) for r in groups.select(*names, digest).collect()), key=str)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_odd_rows_equal_a_walk(spark, frequent):
    """Also where most or all pairs are too rare to be sent to the tasks."""
    names = ("row", "a", "b", "steps", "wide", "id", "groups", "n", "best")
    df = spark.createDataFrame(ODD, KIND).repartition(3).withColumns({n: F.lit("x") for n in names})
    aligned = alignment.aligned_scripts(df, BYTE_BPE, PIECE_BPE)
    strengths = alignment.link_strengths(aligned, alignment.link_counts(aligned), frequent)
    assert digests(aligned, strengths) == sorted(figures(ODD), key=str)


def test_some_texts_have_no_tokens():
    without = {item for item, *rest in figures(ODD) if not any(rest)}
    assert {2, 3, 5} <= without and 1 not in without and 4 not in without


def test_counts_hand_over_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED", 3)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 30)
    rows = [(i, f"script number {i} of {i % 3} parts") for i in range(50)]
    aligned = alignment.aligned_scripts(spark.createDataFrame(rows, KIND).repartition(4), BYTE_BPE, PIECE_BPE)
    found = {(r.a_id, r.b_id): r.n for r in alignment.link_counts(aligned).collect()}
    assert found == Counter(link for *_, links in plain([text for _, text in rows]) for link in links)


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    aligned = alignment.aligned_scripts(empty, BYTE_BPE, PIECE_BPE)
    strengths = alignment.link_strengths(aligned, alignment.link_counts(aligned))
    assert strengths.count() == 0 and alignment.token_groups(aligned).count() == 0


def test_both_byte_tokenizers_agree():
    """The fast library and the file's own, also where a file does not allow the fast one."""
    file = Path(BYTE_BPE).read_bytes()
    described = json.loads(file)
    described["pre_tokenizer"]["add_prefix_space"] = True
    other = alignment.ByteTokens(json.dumps(described).encode())
    fast = alignment.ByteTokens(file)
    plain_side = tokenizers.Tokenizer.from_file(BYTE_BPE)
    plain_side.encode_special_tokens = True
    texts = [text for _, text in ODD if text]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    expected = [plain_side.encode(f" {text}", add_special_tokens=False).ids for text in texts]
    assert fast.encode(texts) == expected == other.encode(texts)


@pytest.fixture(scope="module")
def sides():
    kinds = {BYTE_BPE: alignment.ByteTokens, PIECE_BPE: alignment.PieceTokens}
    return [alignment._Side(kind(Path(file).read_bytes())) for file, kind in kinds.items()]


def test_texts_that_are_not_spelled_have_no_tokens(sides):
    texts = [b"good", b"not \xff readable", b"", "low ▁ line".encode(), b"good"]
    a, b, steps = alignment._aligned(texts, *sides, False)
    assert [len(x.as_py()) > 0 for x in steps] == [True, False, False, False, True]
    assert a[0] == a[4] and [len(x.as_py()) > 0 for x in b] == [True, False, False, False, True]


def test_ids_beyond_two_bytes(sides):
    """Wide ids are packed in four bytes."""
    chunks = [
        alignment._Chunk(*alignment._aligned([b"some words", b"", b"more"], *sides, wide), pa.array([wide] * 3))
        for wide in (False, True)
    ]
    assert chunks[0].a.itemsize == 2 and chunks[1].a.itemsize == 4
    assert (chunks[0].links() == chunks[1].links()).all()
    assert chunks[0].n_a.tolist() == chunks[1].n_a.tolist() == [2, 0, 1]


def test_query_equals_a_walk(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = QUERIES["op13_token_alignment"](spark, folder)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.columns == names
    assert sorted(map(tuple, found.collect()), key=str) == sorted(figures(rows), key=str)
