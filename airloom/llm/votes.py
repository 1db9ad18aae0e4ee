"""Quality of scripts by the votes of similar reviewed scripts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from airloom.llm.common import hash_key, written

BINS = 4096
RANK = 64
NEIGHBOURS = 25
PER_LABEL = 1500
SHARPNESS = 8
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class VoteModel:
    """``weights`` (a number per bin), ``axes`` (bins x rank), the reviewed scripts' unit
    ``vectors`` in that space, their labels ``passed``, and what to say without neighbours.
    """

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    passed: np.ndarray
    prior: float


def text_counts(texts: list[bytes]) -> np.ndarray:
    """Trigrams of bytes in hashed bins, a row per text; whole texts, a block of bytes at a time."""
    counts = np.zeros((len(texts), BINS), dtype=np.float32)
    pending: list[tuple[int, bytes]] = []
    waiting = 0

    def flush() -> None:
        joined = np.frombuffer(b"".join(part for _, part in pending), dtype=np.uint8).astype(np.uint32)
        lengths = np.array([len(part) for _, part in pending])
        code = joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA77)
        code = (code + joined[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
        part = np.repeat(np.arange(len(pending)), lengths)
        inside = part[:-2] == part[2:]
        cells = part[:-2][inside] * BINS + code[inside]
        found = np.bincount(cells, minlength=len(pending) * BINS).reshape(-1, BINS)
        np.add.at(counts, [row for row, _ in pending], found)
        pending.clear()

    for row, text in enumerate(texts):
        # Parts overlap by two bytes, so that no trigram is lost between them.
        for start in range(0, max(0, len(text) - 2), BLOCK_BYTES):
            part = text[start : start + BLOCK_BYTES + 2]
            pending.append((row, part))
            waiting += len(part)
            if waiting >= BLOCK_BYTES:
                flush()
                waiting = 0
    if pending:
        flush()
    return counts


def _vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts)
    rows *= weights
    return _unit(rows)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in place; empty rows stay."""
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    norms[norms <= 1e-12] = np.inf
    rows /= norms
    return rows


def fit_votes(
    content: DataFrame,
    reviews: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    passed: str = "passed",
    per_label: int = PER_LABEL,
) -> VoteModel:
    """Latent-semantic vectors of reviewed scripts.

    At most ``per_label`` scripts that passed and as many that did not, the first in a seeded hash
    order, are the sample: a bound on what is fitted, broadcast and compared. Reviews without
    id or label, and reviews of unknown content, are left out. Counts are made on the executors;
    the driver decomposes a matrix of at most twice ``per_label`` rows and 4,096 columns.
    """
    labels = reviews.select(F.col(content_id).alias("_id"), F.col(passed).cast("int").alias("_passed"))
    order = hash_key("votes", F.col("_id"))
    sample = None
    for label in (0, 1):
        known = labels.where(F.col("_id").isNotNull() & (F.col("_passed") == label)).distinct()
        # Twice as many, as some may have no script.
        first = known.orderBy(order, "_id").limit(2 * per_label)
        sample = first if sample is None else sample.unionByName(first)
    sample = written(sample, "vote-sample")
    texts = content.select(F.col(content_id).alias("_id"), F.col(script).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = text_counts(_bytes(part.column(1)))
                bins = [np.flatnonzero(row).astype(np.uint16) for row in found]
                counts = [row[b].astype(np.uint32).tobytes() for row, b in zip(found, bins, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([b.tobytes() for b in bins], pa.binary()),
                        pa.array(counts, pa.binary()),
                        part.column(2),
                    ],
                    ["passed", "bins", "counts", "key"],
                )

    joined = texts.join(sample, "_id").select("_passed", "text", order.alias("key"))
    counted = written(
        joined.mapInArrow(count, "passed int, bins binary, counts binary, key bigint"), "vote-counts"
    )
    first = [
        counted.where(F.col("passed") == label).orderBy("key", "bins", "counts").limit(per_label)
        for label in (0, 1)
    ]
    chosen = written(first[0].unionByName(first[1]).select("passed", "bins", "counts"), "vote-rows")
    labels_of, counts = [], np.zeros((chosen.count(), BINS), dtype=np.float32)
    for row in chosen.orderBy("passed", "bins", "counts").toLocalIterator():
        counts[len(labels_of), np.frombuffer(row.bins, np.uint16)] = np.frombuffer(row.counts, np.uint32)
        labels_of.append(row.passed)
    return decompose(counts, np.array(labels_of, dtype=np.float32))


def decompose(counts: np.ndarray, passed: np.ndarray, rank: int = RANK) -> VoteModel:
    """Inverse document frequencies and the leading singular axes of the sample."""
    n = len(counts)
    weights = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = _vectors(counts, weights)
    rng = np.random.default_rng(0)
    basis = rng.standard_normal((BINS, min(BINS, rank + 16))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(vectors.T @ (vectors @ basis))
    _, _, turns = np.linalg.svd(vectors @ basis, full_matrices=False)
    axes = (basis @ turns[:rank].T).astype(np.float32) if n else basis[:, :rank]
    prior = float(passed.mean()) if n else 0.5
    return VoteModel(weights, axes, _unit(vectors @ axes), passed, prior)


def votes(model: VoteModel, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The share of passed scripts among the nearest reviewed ones, weighted by similarity.

    Cosines with all reviewed scripts, a block of scripts at a time. Either label counts as
    much in all, however many of it were reviewed.
    """
    scores = np.full(len(counts), model.prior)
    if not len(model.passed):
        return scores
    share = np.clip(model.passed.mean(), 1e-9, 1 - 1e-9)
    balance = np.where(model.passed > 0, 0.5 / share, 0.5 / (1 - share)) if 0 < model.passed.mean() < 1 else np.ones_like(model.passed)
    similar = _unit(_vectors(counts, model.weights) @ model.axes) @ model.vectors.T
    k = min(neighbours, similar.shape[1])
    nearest = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(similar, nearest, axis=1), 0, 1) ** SHARPNESS * balance[nearest]
    total = weight.sum(axis=1)
    known = total > 1e-12
    scores[known] = (weight * model.passed[nearest]).sum(axis=1)[known] / total[known]
    return np.clip(scores, 0.0, 1.0)


def _bytes(column: pa.Array) -> list[bytes]:
    return [text.as_buffer().to_pybytes() if text.is_valid else b"" for text in column]


def quality_votes(
    content: DataFrame, model: VoteModel, content_id: str = "content_id", script: str = "script"
) -> DataFrame:
    """``content`` with ``vote`` added: how likely its script passes review, 0 to 1.

    The whole script is hashed, projected on the model's axes, compared with every reviewed script
    of the sample, and the labels of the nearest are weighted by similarity. A script without
    three bytes, or NULL, is like no other: it gets the share of passed scripts in the sample
    (1/2 if there is none). One row per row of ``content``; a column ``vote`` is replaced.
    """
    columns = [name for name in content.columns if name != "vote"]
    kept = content.select(*(F.col(f"`{name}`") for name in columns))
    place = columns.index(script)
    schema = StructType([*kept.schema.fields, StructField("vote", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = _bytes(part.column(place).cast(pa.string()))
                scores = pa.array(votes(model, text_counts(texts)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*columns, "vote"])

    return kept.mapInArrow(run, schema)
