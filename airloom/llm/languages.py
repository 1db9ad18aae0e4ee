"""The languages of a script and their shares, as a mixture of n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1 << 15
UNDETERMINED = "und"
BLOCK_CELLS = 1 << 22
ROUNDS = 40


@dataclass(frozen=True)
class LanguageModel:
    """The languages in order of name, and the log probability of each n-gram bin (bins x languages)."""

    languages: list[str]
    log_p: np.ndarray


def _blocks(text: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins of the byte trigrams around every byte of every word, and where each word starts.

    Words are lower-cased and set between spaces; a block holds about ``most`` bytes.
    """
    words, size = [], 0
    for word in text.lower().encode("utf-8", "surrogatepass").split():
        words.append(word)
        size += len(word) + 1
        if size >= most:
            yield _bins(words)
            words, size = [], 0
    if words:
        yield _bins(words)


def _bins(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    code = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77)
    code = (code + data[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(17)
    inside = data[1:-1] != 32
    first = np.flatnonzero(inside & (data[:-2] == 32))
    return code[inside], (np.cumsum(inside) - 1)[first]


def fit_languages(
    content: DataFrame, script: str = "script", language: str = "language"
) -> LanguageModel:
    """N-gram counts of all scripts of each known language, with add-half smoothing.

    Counted on the executors, a row of 32,768 counters for each language in a task, and merged
    before and after the shuffle. The driver receives the merged model: its size depends on the
    number of languages alone. Rows without script or language are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                if name.is_valid and text.is_valid:
                    total = counts.setdefault(name.as_py(), np.zeros(BINS, dtype=np.int64))
                    for bins, _ in _blocks(text.as_py(), BLOCK_CELLS):
                        total += np.bincount(bins, minlength=BINS)
        for name, total in counts.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * max(1, len(seen))),
                    pa.array(seen if len(seen) else [0], pa.int32()),
                    pa.array(total[seen] if len(seen) else [0], pa.int64()),
                ],
                ["language", "bin", "n"],
            )

    counted = (
        content.select(F.col(language).cast("string"), F.col(script).cast("string"))
        .mapInArrow(run, "language string, bin int, n bigint")
        .groupBy("language", "bin")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(set(counted["language"].to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((BINS, len(languages)), dtype=np.float64)
    columns = [number[name] for name in counted["language"].to_pylist()]
    counts[counted["bin"].to_numpy(), columns] = counted["n"].to_numpy()
    log_p = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BINS))
    return LanguageModel(languages, log_p.astype(np.float32))


def word_likelihoods(model: LanguageModel, text: str) -> np.ndarray:
    """Log likelihood of every word in every language (words x languages)."""
    most = max(1 << 12, BLOCK_CELLS // max(1, len(model.languages)))
    parts = [np.add.reduceat(model.log_p[bins], starts, axis=0) for bins, starts in _blocks(text, most)]
    return np.concatenate(parts) if parts else np.zeros((0, len(model.languages)), np.float32)


def _maximise(likely: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares by expectation-maximisation, and the log likelihood they reach."""
    top = likely.max(axis=1, keepdims=True)
    weight = np.exp(likely - top)
    shares = np.full(likely.shape[1], 1.0 / likely.shape[1])
    for _ in range(ROUNDS):
        mixed = weight @ shares
        new = shares * (weight / mixed[:, None]).mean(axis=0)
        done = np.abs(new - shares).max() < 1e-4
        shares = new
        if done:
            break
    return shares, float(np.log(weight @ shares).sum() + top.sum())


def mixture(model: LanguageModel, text: str | None) -> list[tuple[str, float]]:
    """The languages of a text with their shares of its words, the largest first.

    Of all languages first, and then of the 1, 2, ... with the largest shares, the set with the best
    penalised likelihood (BIC: half the log of the words for each further language) is taken.
    """
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return []
    likely = word_likelihoods(model, text).astype(np.float64)
    shares, _ = _maximise(likely)
    order = np.argsort(-shares, kind="stable")
    order = order[: max(1, int((shares > 0.01).sum()))]
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for size in range(1, len(order) + 1):
        chosen = order[:size]
        found, reached = _maximise(likely[:, chosen])
        cost = 0.5 * (size - 1) * np.log(len(likely)) - reached
        if best is None or cost < best[0] - 1e-9:
            best = (cost, chosen, found)
    _, chosen, found = best
    ranked = sorted(zip(chosen, found, strict=True), key=lambda x: (-x[1], x[0]))
    return [(model.languages[i], float(share)) for i, share in ranked]


def script_languages(
    content: DataFrame, model: LanguageModel, content_id: str = "content_id", script: str = "script"
) -> DataFrame:
    """``(content_id, language, share, languages, shares)``, a row per row of ``content``.

    The whole script is a mixture of languages, word by word: see :func:`mixture`. ``language`` is
    the one with the largest share, ties by name; ``languages`` and ``shares`` list all that were
    selected. A script without a letter, or NULL, is ``und`` with share 0 and empty lists, and
    so is everything if no language was learned. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mixture(model, text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0][0] if f else UNDETERMINED for f in found], pa.string()),
                    pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                    pa.array([[name for name, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[share for _, share in f] for f in found], pa.list_(pa.float64())),
                ],
                ["content_id", "language", "share", "languages", "shares"],
            )

    kind = content.select(content_id).schema[0].dataType.simpleString()
    return content.select(F.col(content_id), F.col(script).cast("string")).mapInArrow(
        run,
        f"content_id {kind}, language string, share double, languages array<string>, "
        "shares array<double>",
    )
