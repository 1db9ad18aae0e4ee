"""Tags, linked programmes and related items.

Matching two sides on a shared tag pairs everything under a frequent tag with everything else
under it. The two matchers here never form such pairs. Tags are put in order, rare ones first, and
tag sets are listed under the prefixes of what they may share, tag by tag (see :func:`_meetings`).
Under a prefix that few distinct sets have, these are compared directly. Under one that many have,
only the first few items are looked up, and the prefix is grown by one more tag. Nothing is lost by
that: items further down are outranked by all of those before them, which share as much at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.tags import tag_set
from airloom.operators.ranking import ranking_by_group
from airloom.operators.skew import salted_join
from airloom.operators.slices import (
    SLICE,
    earlier_slices,
    in_slices,
    join_carry,
    require,
    slice_totals,
    within_slice,
)
from airloom.session import stored

PAIR_LIMIT = 256


@dataclass(frozen=True)
class _Level:
    """Who meets under the prefixes of one length.

    ``pairs`` has a row per prober and lister under a prefix with few listers, with the number of
    further tags that they share; ``probes`` one per prober and prefix with many, ``frequent``
    these prefixes with their number of items, and ``listed`` their listers.
    """

    length: int
    pairs: DataFrame
    probes: DataFrame
    frequent: DataFrame
    listed: DataFrame


def _in_order(sets: DataFrame, supports: DataFrame) -> DataFrame:
    """``sets`` with the tags of ``supports`` in ``_rest``, rare ones first; sets without are left out."""
    tagged = sets.select("_set", F.explode("_set").alias("_tag"))
    ordered = (
        tagged.join(supports, "_tag")
        .groupBy("_set")
        .agg(F.sort_array(F.collect_list(F.struct("_support", "_tag"))).alias("_ordered"))
        .select("_set", F.col("_ordered._tag").alias("_rest"))
    )
    return sets.join(ordered, "_set")


def _grown(rows: DataFrame, least: Column) -> DataFrame:
    """Every prefix with one more tag of the rest; only those that can still reach ``least`` tags."""
    longer = rows.select(
        *(name for name in rows.columns if name not in ("_prefix", "_rest")),
        F.col("_prefix").alias("_shorter"),
        F.col("_rest").alias("_tags"),
        F.posexplode("_rest").alias("_at", "_tag"),
    )
    return (
        longer.withColumns(
            {
                "_prefix": F.array_append("_shorter", F.col("_tag")),
                "_rest": F.slice("_tags", F.col("_at") + 2, F.size("_tags")),
            }
        )
        .where(F.size("_prefix") + F.size("_rest") >= least)
        .drop("_shorter", "_tags", "_at", "_tag")
    )


def _meetings(
    listers: DataFrame, probers: DataFrame | None, pair_limit: int, least: Column
) -> Iterator[_Level]:
    """Let ``probers`` meet the ``listers`` with which they share a tag, prefix by prefix.

    ``listers`` are distinct sets ``(_set, _rest, _n, ...)``, ``probers`` ``(_set, _rest, ...)``;
    without probers, the listers meet each other. A prefix with more than ``pair_limit`` listers
    is grown, and growing stops when there is none. So a set has a row for each of its prefixes
    that are frequent and one tag more, and at most ``pair_limit`` pairs under each of the others.
    The tables of each length are written to the shared folder, which cuts lineage as well.
    """
    if pair_limit < 1:
        raise ValueError("pair_limit is at least 1")
    start = F.array().cast("array<string>")
    lists = listers.withColumn("_prefix", start)
    probes = None if probers is None else probers.withColumn("_prefix", start)
    length = 0
    while True:
        length += 1
        lists = stored(_grown(lists, least), "tag-lists")
        probes = None if probes is None else stored(_grown(probes, least), "tag-probes")
        asking = lists if probes is None else probes
        counts = stored(
            lists.groupBy("_prefix").agg(
                F.count(F.lit(1)).alias("_width"),
                F.sum("_n").alias("_all"),
                F.max(F.size("_rest")).alias("_left"),
            ),
            "tag-counts",
        )
        few = counts.where(F.col("_width") <= pair_limit).select("_prefix")
        many = counts.where(F.col("_width") > pair_limit)
        frequent = many.select("_prefix", "_all")
        # Never broadcast: the lists have up to pair_limit rows a key, whatever the estimate.
        found = lists.join(few, "_prefix").select(
            "_prefix",
            *(F.col(n).alias(f"_l{n}") for n in lists.columns if n not in ("_prefix", "_set")),
        )
        pairs = (
            asking.join(found.hint("merge"), "_prefix")
            .withColumn("_more", F.size(F.array_intersect("_rest", "_l_rest")))
            .drop("_rest", "_l_rest")
        )
        crowded = frequent.select("_prefix")
        probing = asking.join(crowded, "_prefix")
        listed = lists.join(crowded, "_prefix")
        yield _Level(length, pairs, probing, frequent, listed)
        if many.where(F.col("_left") > 0).isEmpty():
            return
        lists = listed
        probes = None if probes is None else probing


def _supports(sets: DataFrame) -> DataFrame:
    tags = sets.select(F.explode("_set").alias("_tag"))
    return tags.groupBy("_tag").agg(F.count(F.lit(1)).alias("_support"))


def first_members(sets: DataFrame, m: int) -> DataFrame:
    """A row per distinct set, with its number of items and the first ``m`` of them."""
    sizes = sets.groupBy("_set").agg(F.count(F.lit(1)).alias("_n"))
    firsts = (
        ranking_by_group(sets, "_set", ["_item"], m)
        .groupBy("_set")
        .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    )
    return sizes.join(firsts, "_set")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def tag_pool(
    profiles: DataFrame,
    items: DataFrame,
    m: int,
    profile: str = "profile_id",
    item: str = "item_id",
    tags: str = "tags",
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Per profile the number of items sharing a tag, and the ``m`` sharing most.

    ``(profile, pool_size, rank, item, shared)``, ties by item. A profile without any match
    keeps one row with pool size 0. Items are unique; sets may have any number of tags.

    ``pair_limit`` does not change the result: up to that many distinct item sets under a
    combination of tags are compared one by one, more are looked up (see :func:`_meetings`).
    Runs jobs while it is built.
    """
    item_sets = items.select(F.col(item).alias("_item"), tag_set(F.col(tags)).alias("_set"))
    listers = stored(first_members(item_sets.where(F.size("_set") > 0), m), "tag-sets")
    supports = stored(_supports(listers), "tag-supports")
    profile_sets = profiles.select(profile, tag_set(F.col(tags)).alias("_set"))
    probers = _in_order(profile_sets.select("_set").distinct(), supports)

    deltas, hits = [], []
    ordered = _in_order(listers, supports).drop("_set")
    for level in _meetings(ordered, probers, pair_limit, F.lit(1)):
        # Inclusion and exclusion: odd combinations count up, even ones down. What a pair adds
        # under all longer prefixes comes to nothing, unless it shares no later tag.
        sign = F.lit(1 if level.length % 2 else -1)
        last = F.when(F.col("_more") == 0, F.col("_l_n")).otherwise(0)
        looked_up = level.probes.select("_set", "_prefix").join(level.frequent, "_prefix")
        deltas.append(level.pairs.select("_set", (sign * last).alias("_delta")))
        deltas.append(looked_up.select("_set", (sign * F.col("_all")).alias("_delta")))
        hits.append(
            level.pairs.select(
                "_set",
                F.explode("_l_items").alias("_item"),
                (F.col("_more") + level.length).alias("_shared"),
            )
        )
        members = level.listed.select("_prefix", F.explode("_items").alias("_item"))
        firsts = ranking_by_group(members, "_prefix", ["_item"], m).drop("rank")
        hits.append(
            level.probes.select("_set", "_prefix")
            .join(firsts.hint("merge"), "_prefix")
            .select("_set", "_item", F.lit(level.length).alias("_shared"))
        )
    pools = _union(deltas).groupBy("_set").agg(F.sum("_delta").alias("pool_size"))
    shared = _union(hits).groupBy("_set", "_item").agg(F.max("_shared").alias("_shared"))
    order = [F.col("_shared").desc(), F.col("_item").asc()]
    best = (
        ranking_by_group(shared, "_set", order, m)
        .groupBy("_set")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "_item", "_shared"))).alias("_best"))
    )
    return (
        salted_join(profile_sets, pools.join(best, "_set", "left"), "_set", [profile], "left")
        .select(
            profile,
            F.coalesce("pool_size", F.lit(0)).cast("bigint").alias("pool_size"),
            F.explode_outer("_best").alias("_hit"),
        )
        .select(
            profile,
            "pool_size",
            F.col("_hit.rank").alias("rank"),
            F.col("_hit._item").alias(item),
            F.col("_hit._shared").alias("shared"),
        )
    )


def related_items(
    items: DataFrame,
    m: int,
    min_sim: float = 0.0,
    item: str = "item_id",
    tags: str = "tags",
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Per item the ``m`` others most alike by Jaccard similarity of their tags.

    ``(item, rank, related_item, similarity)``, with a similarity above 0 and of at least
    ``min_sim``; ties by item. Items are unique; sets may have any number of tags.

    ``pair_limit`` does not change the result: up to that many distinct sets under a combination
    of tags are compared one by one, more are looked up (see :func:`_meetings`). Combinations that
    ``min_sim`` rules out are not formed, and tags of a single distinct set only count in
    its size. Runs jobs while it is built.
    """
    if not 0 <= min_sim <= 1:
        raise ValueError("a similarity lies between 0 and 1")
    sets = items.select(F.col(item).alias("_item"), tag_set(F.col(tags)).alias("_set"))
    sets = sets.where(F.size("_set") > 0)
    # One more than m, as an item finds itself as well.
    listers = stored(first_members(sets, m + 1), "tag-sets")
    supports = stored(_supports(listers).where(F.col("_support") > 1), "tag-supports")
    ordered = _in_order(listers, supports).withColumn("_size", F.size("_set"))
    # Two sets as similar as min_sim share at least that part of the larger one.
    least = F.ceil(F.col("_size") * F.lit(float(min_sim)) - F.lit(1e-9)).cast("int")

    # The items of one set are all alike.
    found = [listers.select("_set", F.explode("_items").alias("_item"), F.lit(1.0).alias("similarity"))]
    for level in _meetings(ordered, None, pair_limit, F.greatest(F.lit(1), least)):
        shared = F.col("_more") + level.length
        found.append(
            level.pairs.select(
                "_set",
                F.explode("_l_items").alias("_item"),
                (shared / (F.col("_size") + F.col("_l_size") - shared)).alias("similarity"),
            ).where(F.col("similarity") >= min_sim)
        )
        members = level.listed.select(
            "_prefix", F.col("_size").alias("_other"), F.explode("_items").alias("_item")
        )
        firsts = ranking_by_group(members, ["_prefix", "_other"], ["_item"], m + 1).drop("rank")
        met = F.lit(level.length)
        found.append(
            level.probes.select("_set", "_size", "_prefix")
            .join(firsts.hint("merge"), "_prefix")
            .select(
                "_set",
                "_item",
                (met / (F.col("_size") + F.col("_other") - met)).alias("similarity"),
            )
            .where(F.col("similarity") >= min_sim)
        )
    candidates = _union(found).groupBy("_set", "_item").agg(F.max("similarity").alias("similarity"))
    return best_others(sets, candidates, m, item)


def best_others(sets: DataFrame, candidates: DataFrame, m: int, item: str) -> DataFrame:
    """Per item of ``sets`` the best ``m`` candidates of its set but for itself, ties by item.

    ``candidates`` are ``(_set, _item, similarity)``, an item once per set, and have the ``m + 1`` best.
    """
    order = [F.col("similarity").desc(), F.col("_item").asc()]
    best = (
        ranking_by_group(candidates, "_set", order, m + 1)
        .groupBy("_set")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "_item", "similarity"))).alias("_best"))
    )
    others = F.filter("_best", lambda other: other["_item"] != F.col("_self"))
    return (
        salted_join(sets.withColumnRenamed("_item", "_self"), best, "_set", ["_self"])
        .select(F.col("_self"), F.posexplode(F.slice(others, 1, m)).alias("_place", "_other"))
        .select(
            F.col("_self").alias(item),
            (F.col("_place") + 1).alias("rank"),
            F.col("_other._item").alias(f"related_{item}"),
            F.col("_other.similarity").alias("similarity"),
        )
    )


def linked_programs(
    content: DataFrame,
    links: DataFrame,
    programs: DataFrame,
    content_id: str = "content_id",
    program_id: str = "program_id",
    ord: str = "ord",
    page_size: int = 100,
) -> DataFrame:
    """Each content item with the ordered array of its programmes.

    ``(*content, page, programs)``; the array holds structs of ``ord``, ``program_id`` and the
    other columns of ``programs``, in order of ``ord`` and then programme. Links beyond the first
    ``page_size`` continue on further pages, a row each, whatever their ``ord``, so that no array
    has more than ``page_size`` entries. Page 0 is always there, if need be empty. Repeated links
    count once; links of unknown content or to unknown programmes are left out. The links of an
    item are numbered in slices, by a job that runs at once.
    """
    if page_size < 1:
        raise ValueError("a page has at least one position")
    details = [name for name in programs.columns if name != program_id]
    known = (
        require(links, content_id, ord)
        .select(content_id, program_id, ord)
        .distinct()
        .join(programs, program_id)
    )
    rows = in_slices(known, [content_id], [ord, program_id])
    carry = slice_totals(rows, [content_id], {"_n": F.count(F.lit(1))}).select(
        content_id, SLICE, F.sum("_n").over(earlier_slices([content_id])).alias("_before")
    )
    place = F.row_number().over(within_slice([content_id], [ord, program_id]))
    number = F.coalesce("_before", F.lit(0)) + F.col("_place") - 1
    entries = join_carry(rows.withColumn("_place", place), carry, [content_id]).select(
        content_id,
        F.floor(number / F.lit(page_size)).cast("int").alias("page"),
        F.struct(ord, program_id, *details).alias("_entry"),
    )
    first_pages = content.select(content_id, F.lit(0).alias("page"))
    pages = (
        entries.unionByName(first_pages, allowMissingColumns=True)
        # Collecting cannot shrink anything before the shuffle, so the plain rows are moved.
        .repartition(content_id, "page")
        .groupBy(content_id, "page")
        .agg(F.sort_array(F.collect_list("_entry")).alias("programs"))
    )
    # An inner join, so that the pages of one item may be split over several tasks.
    return content.join(pages, content_id)


def expand_batch(targets: DataFrame, k: int | Column) -> DataFrame:
    """One task row per target and slot 1..k; targets whose ``k`` is below 1 get none."""
    count = F.lit(k) if isinstance(k, int) else k
    wanted = F.when(count >= 1, F.sequence(F.lit(1), count.cast("int")))
    return targets.withColumn("slot", F.explode(wanted))
