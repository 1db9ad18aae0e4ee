"""Related items for tags in very many sets: nearly all of the best, in rows that grow with the items.

:func:`airloom.operators.tags.related_items` is exact, and pays for tags that very many distinct sets
have with a row per set and combination of these tags. Here every distinct set is put in order under a
number of independent MinHash signatures. Sets that agree in the first places of a signature stand
together, the longer the agreement the closer, so a set is only compared with its neighbours in each
order. How frequent a tag is makes no difference to the number of comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.tags import tag_set
from airloom.operators.ranking import ranking_by_group
from airloom.operators.slices import SLICE, earlier_slices, in_slices, join_carry, slice_totals, within_slice
from airloom.operators.tags import best_others, first_members
from airloom.session import stored

TREES = 32
DEPTH = 6
REACH = 8
#: Places of an order that one window group has; neighbours over its end are copied.
CHUNK = 1 << 13


def _signature(tree: Column, depth: int) -> Column:
    """``depth`` MinHash values of ``_set``, each of the tree's own hash functions."""

    def least(place: Column) -> Column:
        return F.array_min(F.transform("_set", lambda tag: F.xxhash64(tag, tree * depth + place)))

    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), least)


def _in_places(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """``sets`` once per tree, with ``_at``, its place in the order of the tree's signatures.

    The places are counted in slices and carried on, so they do not depend on the partitions.
    """
    planted = sets.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = ["_signature", "_set"]
    rows = in_slices(planted.withColumn("_signature", _signature(F.col("_tree"), depth)), ["_tree"], order)
    carry = slice_totals(rows, ["_tree"], {"_n": F.count(F.lit(1))}).select(
        "_tree", SLICE, F.sum("_n").over(earlier_slices(["_tree"])).alias("_before")
    )
    place = rows.withColumn("_place", F.row_number().over(within_slice(["_tree"], order)))
    return join_carry(place, carry, ["_tree"]).select(
        "_tree", (F.coalesce("_before", F.lit(0)) + F.col("_place") - 1).alias("_at"), *sets.columns
    )


def _neighbours(placed: DataFrame, reach: int, chunk: int) -> DataFrame:
    """Pairs of sets at most ``reach`` places apart in the order of a tree, earlier one first."""
    own = F.floor(F.col("_at") / F.lit(chunk))
    # The first places of a chunk are the last neighbours of the chunks before.
    earliest = F.greatest(F.lit(0), F.floor((F.col("_at") - reach) / F.lit(chunk)))
    copied = placed.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(earliest, own)))
    ahead = Window.partitionBy("_tree", "_chunk").orderBy("_at").rowsBetween(1, reach)
    following = F.collect_list(F.struct("_set", "_first")).over(ahead)
    return (
        copied.withColumn("_following", following)
        .where(F.col("_chunk") == F.col("_own"))
        .select("_set", "_first", F.explode("_following").alias("_o"))
        .select("_set", "_first", F.col("_o._set").alias("_other"), F.col("_o._first").alias("_other_first"))
    )


def similar_items(
    items: DataFrame,
    m: int,
    min_sim: float = 0.0,
    item: str = "item_id",
    tags: str = "tags",
    trees: int = TREES,
    depth: int = DEPTH,
    reach: int = REACH,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per item up to ``m`` others alike by Jaccard similarity of their tags, nearly always the best.

    ``(item, rank, related_item, similarity)`` as in :func:`airloom.operators.tags.related_items`, with
    a similarity above 0 and of at least ``min_sim``; ties by item. Similarities are exact, and
    items with the same tags always find each other. Other pairs are compared if they are at most
    ``reach`` places apart in one of ``trees`` orders by signatures of ``depth`` MinHash values, so
    an item may miss some of its best; more trees or a longer reach find more. Over all orders
    that makes ``trees`` rows and ``trees * reach`` comparisons for each distinct tag set, whatever
    the tags. The result does not depend on the partitions or on ``chunk``, which bounds the rows that one
    task has to order at a time.

    Items are unique. NULL tags are left out; items without tags (NULL or empty) have no row and are
    in none; an empty table gives an empty result. Runs jobs while it is built.
    """
    if not 0 <= min_sim <= 1:
        raise ValueError("a similarity lies between 0 and 1")
    if min(trees, depth, reach, chunk) < 1:
        raise ValueError("trees, depth, reach and chunk are at least 1")
    sets = items.select(F.col(item).alias("_item"), tag_set(F.col(tags)).alias("_set"))
    sets = sets.where(F.size("_set") > 0)
    # One more than m, as an item finds itself as well.
    listers = stored(first_members(sets, m + 1), "tag-sets")
    placed = _in_places(listers.select("_set", F.get("_items", F.lit(0)).alias("_first")), trees, depth)
    shared = F.size(F.array_intersect("_set", "_other"))
    pairs = (
        _neighbours(placed, reach, chunk)
        .withColumn("_shared", shared)
        .withColumn(
            "similarity", F.col("_shared") / (F.size("_set") + F.size("_other") - F.col("_shared"))
        )
        .where((F.col("_shared") > 0) & (F.col("similarity") >= min_sim))
    )
    names = ["_set", "_other", "_other_first", "similarity"]
    turned = pairs.select(
        F.col("_other").alias("_set"), F.col("_set").alias("_other"),
        F.col("_first").alias("_other_first"), "similarity",
    )
    # The best m items are in the first m sets, if sets in a tie go by their first item.
    closest = ranking_by_group(
        pairs.select(*names).unionByName(turned).distinct(),
        "_set",
        [F.col("similarity").desc(), F.col("_other_first").asc()],
        m,
    )
    members = listers.select(F.col("_set").alias("_other"), F.explode("_items").alias("_item"))
    # Never broadcast: a set has up to m + 1 items here, which an estimate does not know.
    others = closest.join(members.hint("merge"), "_other").select("_set", "_item", "similarity")
    alike = listers.select("_set", F.explode("_items").alias("_item"), F.lit(1.0).alias("similarity"))
    return best_others(sets, others.unionByName(alike), m, item)
