"""Related catalogue items by their feature vectors: exact search for the largest inner products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import written

#: Vectors to a block, and so the most that a task holds of either side.
BLOCK = 16_384
#: The rotation is fitted on so many of the longest vectors, and on so many of their coordinates.
SAMPLE, TURNED = 4_096, 512
#: Rotated coordinates that are compared before the rest.
HEADS = 16
#: Vectors compared at a time within a task: of those wanted, and of the others.
WANTED_STEP, STEP = 512, 2_048
#: Up to this, doubles hold whole numbers exactly.
EXACT = 2.0**53
BIGINT = -(2**63), 2**63 - 1


def related_by_features(
    items: DataFrame,
    wanted: Column | str,
    m: int = 20,
    item: str = "item_id",
    features: str = "features",
    steps: int = 64,
    block: int = BLOCK,
) -> DataFrame:
    """The ``m`` items with the largest inner product, for each item that is ``wanted``.

    ``(item, rank, related_item, score)``. ``items`` are catalogue entries with an array of numbers
    (say, weights of their tags, or figures of their effect); ``wanted`` is a condition on them,
    NULL being false.
    Features count in whole steps, ``floor(steps * x)``, so scores are exact whole numbers.
    Ties go to the smaller item, NULL last. An item is not related to its own row; repeated rows
    are items of their own, and so is a row without an id.

    Left out on both sides: vectors that are NULL or hold NULL, NaN or an infinite number. A
    shorter vector counts as zero where a longer one goes on; an empty one scores 0 with all.
    Steps and scores beyond the range of a bigint stop at its ends. No items or none wanted: no
    rows. Other columns of ``items`` are ignored.

    Vectors are dealt to blocks of about ``block`` rows in order of descending length, ties by a
    hash of the row, so that equal vectors spread. Wanted vectors form blocks of their own. Rounds
    compare them with the longest block, the next three, the next twelve and so on; between the
    rounds, the ``m`` best so far of each give the score to beat. A pair of blocks is only brought
    together if the product of lengths (Cauchy-Schwarz) can reach that score. Inside a task,
    the leading coordinates after a rotation (singular vectors of a bounded ``SAMPLE`` of the longest
    vectors; it changes no result) are multiplied first, and the lengths of what is left
    bound the rest. Only what can still reach the score is multiplied out. Each pair of blocks
    gives at most ``m`` rows per wanted vector. Runs jobs while it is built.
    """
    if m < 1 or steps < 1 or block < 1:
        raise ValueError("m, steps and block are at least 1")
    vectors = _vectors(items, wanted, item, features, steps)
    rows, n_wanted = vectors.agg(F.count(F.lit(1)), F.count_if("_wanted")).first()
    if not n_wanted:
        kind = vectors.schema["_item"].dataType.simpleString()
        ranked = items.sparkSession.createDataFrame([], f"{_best(kind)}, _rank int")
    else:
        blocks = _by_length(vectors, rows, block)
        queries = _by_length(vectors.where("_wanted"), n_wanted, block)
        turn = _rotation(blocks)
        ranked = _search(blocks, queries, m, turn)
    asked = vectors.where("_wanted").select(F.col("_key").alias("_wanted_key"), F.col("_item").alias(item))
    return ranked.join(asked, "_wanted_key").select(
        item,
        F.col("_rank").alias("rank"),
        F.col("_related").alias(f"related_{item}"),
        F.col("_score").alias("score"),
    )


def _vectors(items: DataFrame, wanted: Column | str, item: str, features: str, steps: int) -> DataFrame:
    """``(_key, _item, _wanted, _vector, _length)`` of all vectors that take part."""
    rows = items.select(
        F.col(item).alias("_item"),
        F.coalesce(F.expr(wanted) if isinstance(wanted, str) else wanted, F.lit(False)).alias("_wanted"),
        F.col(features).cast("array<double>").alias("_vector"),
    )
    infinite = F.lit(math.inf)
    odd = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    # As a double first: floor() of a double beyond a bigint stops at its ends.
    whole = F.transform("_vector", lambda x: F.floor(x * F.lit(float(steps))))
    numbered = rows.where(F.col("_vector").isNotNull() & ~odd).withColumn("_vector", whole)
    squares = F.aggregate(
        "_vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return written(
        numbered.select(F.monotonically_increasing_id().alias("_key"), "*", F.sqrt(squares).alias("_length")),
        "vectors",
    )


def _by_length(vectors: DataFrame, rows: int, block: int) -> DataFrame:
    """The vectors with the number of their block, 0 for the longest."""
    order = [F.desc("_length"), F.xxhash64("_key")]
    dealt = vectors.select("_key", "_item", "_vector", "_length").repartitionByRange(
        math.ceil(rows / block), *order
    )
    return written(dealt.withColumn("_block", F.spark_partition_id()), "vector-blocks")


def _rotation(blocks: DataFrame) -> np.ndarray:
    """The leading singular vectors of a bounded sample of the longest vectors, a column each."""
    sample = blocks.where("_block = 0").orderBy(F.desc("_length"), "_key").limit(SAMPLE)
    parts = sample.select(F.slice("_vector", 1, TURNED).alias("_vector")).toArrow().column(0)
    rows = _matrix(parts, _width(parts)) / _largest(parts)
    if not rows.size:
        return np.zeros((0, 0))
    _, _, turns = np.linalg.svd(rows, full_matrices=False)
    return turns[:HEADS].T.copy()


def _best(kind: str) -> str:
    return f"_wanted_key bigint, _score bigint, _related {kind}, _key bigint"


def _search(blocks: DataFrame, queries: DataFrame, m: int, turn: np.ndarray) -> DataFrame:
    """The ``m`` best rows for each wanted vector: ``(_wanted_key, _score, _related, _key, _rank)``."""
    lengths = written(
        blocks.groupBy(F.col("_block").alias("_other")).agg(F.max("_length").alias("_longest")), "block-lengths"
    )
    last = lengths.agg(F.max("_other")).first()[0]
    items = blocks.select(F.col("_block").alias("_other"), "_key", "_item", "_vector", "_length")
    schema = _best(blocks.schema["_item"].dataType.simpleString())
    compare = _comparison(m, turn)
    best = blocks.sparkSession.createDataFrame([], f"{schema}, _rank int")
    low, high = 0, 1
    while low <= last:
        reached = best.groupBy(F.col("_wanted_key").alias("_key")).agg(
            F.when(F.count(F.lit(1)) >= m, F.min("_score")).alias("_reached")
        )
        asking = written(queries.join(reached, "_key", "left"), "wanted-vectors")
        # The shortest vector that can still be among the best of some wanted one.
        needed = F.when(F.col("_reached") > 0, F.col("_reached") / F.col("_length"))
        tiles = (
            asking.groupBy("_block")
            .agg(F.min(F.coalesce(needed, F.lit(0.0))).alias("_needed"))
            .withColumn("_other", F.explode(F.sequence(F.lit(low), F.lit(min(high, last + 1) - 1))))
            .join(lengths, "_other")
            .where(F.col("_longest") * (1 + 1e-9) >= F.col("_needed"))
            .select("_block", "_other")
        )
        tiles = written(tiles, "block-pairs")
        if not tiles.isEmpty():
            met = asking.join(tiles, "_block").groupBy("_block", "_other")
            met = met.cogroup(items.join(tiles, "_other").groupBy("_block", "_other")).applyInArrow(compare, schema)
            ranked = best.drop("_rank").unionByName(met).withColumn("_rank", _rank())
            best = written(ranked.where(F.col("_rank") <= m), "related")
        low, high = high, high * 4
    return best


def _rank() -> Column:
    order = [F.desc("_score"), F.asc_nulls_last("_related"), F.asc("_key")]
    return F.row_number().over(Window.partitionBy("_wanted_key").orderBy(*order))


def _comparison(m: int, turn: np.ndarray):
    """The function for two blocks: the best of one for each vector of the other."""

    def compare(wanted: pa.Table, others: pa.Table) -> pa.Table:
        # The longest first.
        others = others.take(np.argsort(-others.column("_length").to_numpy(), kind="stable"))
        largest = _largest(wanted.column("_vector")) * _largest(others.column("_vector"))
        width = max(_width(wanted.column("_vector")), _width(others.column("_vector")))
        # Doubles hold all sums of products exactly, or Python's whole numbers take their place.
        kind = np.float64 if largest * max(1, width) < EXACT else object
        ours, theirs = _Block(wanted, width, kind, turn), _Block(others, width, kind, turn)
        place = _places(others.column("_item"))
        keys, scores, at = [], [], []
        for start in range(0, wanted.num_rows, WANTED_STEP):
            rows = slice(start, start + WANTED_STEP)
            row, score, other = _best_of(ours.part(rows), _reached(wanted, rows), theirs, place, m)
            keys.append(ours.key[rows][row])
            scores.append(score)
            at.append(other)
        found = others.take(np.concatenate(at))
        return pa.table(
            {
                "_wanted_key": pa.array(np.concatenate(keys), pa.int64()),
                "_score": pa.array([int(x) for x in np.concatenate(scores)], pa.int64()),
                "_related": found.column("_item"),
                "_key": found.column("_key"),
            }
        )

    return compare


class _Block:
    """Vectors of a block: whole numbers, rotated leading coordinates, and the length of the rest."""

    def __init__(self, table: pa.Table, width: int, kind: type, turn: np.ndarray) -> None:
        self.vector = _matrix(table.column("_vector"), width, kind)
        self.key = table.column("_key").to_numpy()
        self.length = table.column("_length").to_numpy()
        # Where all vectors are shorter than the fitted ones, what is missing is zero.
        turned = min(width, len(turn))
        self.head = self.vector[:, :turned].astype(np.float64) @ turn[:turned]
        left = self.length**2 - np.einsum("ij,ij->i", self.head, self.head)
        # A little more, for rounding.
        self.rest = np.sqrt(np.maximum(left, 0)) + 1e-6 * self.length

    def part(self, rows: slice) -> _Block:
        found = object.__new__(_Block)
        found.__dict__ = {name: value[rows] for name, value in self.__dict__.items()}
        return found


def _reached(wanted: pa.Table, rows: slice) -> np.ndarray:
    values = wanted.column("_reached").to_pylist()[rows]
    return np.array([-np.inf if x is None else float(x) for x in values])


def _width(column: pa.ChunkedArray) -> int:
    return max(pc.max(pc.list_value_length(column)).as_py() or 0, 0)


def _largest(column: pa.ChunkedArray) -> float:
    values = pc.min_max(pc.list_flatten(column)).as_py()
    return max(abs(float(values["min"] or 0)), abs(float(values["max"] or 0)), 1.0)


def _matrix(column: pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """A row for each vector, with zeros where it ends."""
    lengths = pc.list_value_length(column).to_numpy()
    values = pc.list_flatten(column).to_numpy()
    rows = np.zeros((len(lengths), width), dtype=kind)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows[np.repeat(np.arange(len(lengths)), lengths), at] = values.tolist() if kind is object else values
    return rows


def _places(column: pa.ChunkedArray) -> np.ndarray:
    """The order of the items, NULL last; equal items have equal places."""
    known = column.unique().drop_null()
    ordered = known.take(pc.sort_indices(known))
    return pc.fill_null(pc.index_in(column, value_set=ordered), len(ordered)).to_numpy()


def _best_of(
    ours: _Block, reached: np.ndarray, theirs: _Block, place: np.ndarray, m: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, scores and places of the ``m`` best of the other block, whose longest vectors come first."""
    kind = ours.vector.dtype
    row, score, other = np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.int64)
    for start in range(0, len(theirs.key), STEP):
        part = theirs.part(slice(start, start + STEP))
        # A little below what is reached, as lengths and heads are rounded.
        longest = ours.length * part.length[0]
        least = reached - 1e-6 * (np.abs(np.where(np.isfinite(reached), reached, 0)) + longest)
        active = np.flatnonzero(longest >= least)
        if not len(active):
            break  # lengths only fall from here on
        most = ours.head[active] @ part.head.T + ours.rest[active][:, None] * part.rest
        near = (most >= least[active][:, None]) & (ours.key[active][:, None] != part.key)
        new_row, new_other, new_score = _multiplied(ours.vector[active], part.vector, near, m)
        new_row, new_other = active[new_row], new_other + start
        if kind == object:
            new_score = np.clip(new_score, *BIGINT)
        good = new_score >= np.nextafter(reached, -np.inf)[new_row]
        row = np.concatenate([row, new_row[good]])
        other = np.concatenate([other, new_other[good]])
        score = np.concatenate([score, new_score[good].astype(kind)])
        # Stable sorts, the last key first.
        by = np.argsort(place[other], kind="stable")
        by = by[np.argsort(-score[by], kind="stable")]
        by = by[np.argsort(row[by], kind="stable")]
        row, other, score = row[by], other[by], score[by]
        counts = np.bincount(row, minlength=len(reached))
        firsts = np.cumsum(counts) - counts
        full = np.flatnonzero(counts >= m)
        reached[full] = np.maximum(reached[full], score[firsts[full] + m - 1].astype(np.float64))
        kept = np.arange(len(row)) - firsts[row] < m
        row, other, score = row[kept], other[kept], score[kept]
    return row, score, other


def _multiplied(
    ours: np.ndarray, theirs: np.ndarray, near: np.ndarray, m: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and products of the near pairs, but of those beyond the ``m`` best of a row."""
    if near.sum() * 8 < near.size:
        row, other = np.nonzero(near)
        return row, other, (ours[row] * theirs[other]).sum(axis=1)
    products = ours @ theirs.T
    if products.dtype != object and near.shape[1] > m:
        products[~near] = -np.inf
        at = near.shape[1] - m
        near &= products >= np.partition(products, at, axis=1)[:, at, None]
    row, other = np.nonzero(near)
    return row, other, products[row, other]
