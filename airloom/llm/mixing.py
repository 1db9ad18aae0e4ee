"""Mixing the scripts of bloggers to target weights (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import WORD, hash_key, root_of, slice_of, written

WEIGHTS = (5, 2, 1)
MOST = 3


def mixture_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """How many words the mix takes from each blogger.

    ``sizes`` has ``(blogger, source_size)``, a row per blogger. Adds ``weight`` and ``target``:
    bloggers in order of name, NULL last, weigh ``weights`` in turn and share the words of all. A
    target stops at ``most`` times the blogger's own words, and the rest is shared by weight among
    the others: sorted by the words per weight at which they stop, a first part of the bloggers
    stops, and the others get the same number of words per weight. All bloggers are one window
    here, a row each.
    """
    named = Window.orderBy(F.col("blogger").asc_nulls_last())
    turn = F.array(*(F.lit(int(weight)) for weight in weights))
    weighed = sizes.withColumn(
        "weight", F.get(turn, ((F.row_number().over(named) - 1) % len(weights)).cast("int"))
    ).withColumn("cap", F.col("source_size") * most)
    stops = Window.orderBy(F.col("cap") / F.col("weight"), F.col("blogger").asc_nulls_last())
    earlier, whole = stops.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    # Words per weight if all bloggers before this one stop and this one does not.
    rate = (F.sum("source_size").over(whole) - capped).cast("double") / left
    rated = weighed.withColumn("rate", rate).withColumn(
        "free", F.col("rate") * F.col("weight") <= F.col("cap")
    )
    common = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rate"))).over(whole)
    share = common["rate"] * F.col("weight")
    return rated.withColumn(
        "target", F.least(share, F.col("cap").cast("double"))
    ).select("blogger", "source_size", "weight", "target")


def split_draws(draws: DataFrame, shards: int, seed: str) -> DataFrame:
    """Deal block draws out to shards by a tree of multivariate hypergeometric splits.

    ``draws`` has one row per ``(stratum, copy, block)``. A node of the tree holds some draws and a
    range of shards. Half of its shards take the first draws of a seeded random order of the node,
    as many as their part of the range, and the other half the rest. How many draws of each
    stratum that gives is a sample of the multivariate hypergeometric distribution of the node's
    quotas, and the quotas of all shards add up to the draws exactly. Adds ``shard``.
    """
    nodes = draws.withColumns({"low": F.lit(0), "high": F.lit(shards)})
    for level in range(max(0, (shards - 1).bit_length())):
        node = Window.partitionBy("low", "high")
        middle = F.shiftright(F.col("low") + F.col("high"), 1)
        order = node.orderBy(
            hash_key(seed, level, F.col("low"), F.col("stratum"), F.col("copy"), F.col("block")),
            "stratum", "copy", "block",
        )
        quota = F.floor(
            F.count(F.lit(1)).over(node) * (middle - F.col("low")) / (F.col("high") - F.col("low"))
        )
        left = (F.col("high") - F.col("low") > 1) & (F.row_number().over(order) <= quota)
        nodes = nodes.withColumns(
            {
                "_low": F.when(left | (F.col("high") - F.col("low") < 2), F.col("low")).otherwise(middle),
                "_high": F.when(left, middle).otherwise(F.col("high")),
            }
        ).select("stratum", "copy", "block", F.col("_low").alias("low"), F.col("_high").alias("high"))
    return nodes.select("stratum", "copy", "block", F.col("low").alias("shard"))


def mix_bloggers(
    content: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    shards: int = 8,
    seed: str = "mix",
    content_id: str = "content_id",
    script: str = "script",
    blogger: str = "blogger",
) -> DataFrame:
    """How often the mix takes each content item, and into which shards.

    Adds to the columns of ``content`` a struct ``mix`` of ``size`` (words of the script),
    ``source_size`` (words of the blogger), ``target`` (see :func:`mixture_targets`), ``copies`` (0
    to ``most``), ``taken`` (words, ``size * copies``) and ``draws``, an array of ``(shard, place)``
    for the copies; the local shuffle of a shard is the order of ``place``.

    Each blogger's items are permuted by a seeded hash and cut into blocks of equal hash ranges.
    The mix takes all blocks as often as the target holds the blogger's words in full, and then
    blocks in permuted order until the target is nearest; of the last block only the items up to
    there. The draws of blocks are dealt out to the shards by :func:`split_draws`.

    Every decision is a function of blogger and hash, so the scripts are not shuffled, and the
    tables joined have a row per blogger or block. One row per row of ``content``; NULL and empty
    scripts have size 0, NULL bloggers mix as one more blogger, and items with equal id and script
    are taken alike. A column ``mix`` of ``content`` is replaced.
    """
    text = F.col(script)
    stratum = F.coalesce(F.concat(F.lit("="), F.col(blogger).cast("string")), F.lit(""))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    key = hash_key(seed, F.col(content_id), F.md5(F.coalesce(text, F.lit(""))))
    items = content.select(
        F.struct(
            F.col(blogger).cast("string").alias("blogger"),
            stratum.alias("stratum"),
            size.alias("size"),
            key.alias("key"),
        ).alias("_mix"),
        F.struct(*(F.col(f"`{name}`") for name in content.columns if name != "mix")).alias("_row"),
    )
    small = written(items.select("_mix.*"), "mix-items")
    sizes = small.groupBy("blogger", "stratum").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    sizes = written(sizes, "mix-sizes")
    targets = mixture_targets(sizes.select("blogger", "source_size"), weights, most)
    stratum = F.coalesce(F.concat(F.lit("="), F.col("blogger")), F.lit(""))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    plans = written(
        targets.withColumn("stratum", stratum)
        .join(sizes.select("stratum", root_of(F.col("n")).alias("blocks")), "stratum")
        .withColumn("epochs", epochs.cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("stratum", "source_size", "target", "blocks", "epochs", "rest"),
        "mix-plans",
    )
    block = slice_of(F.col("key"), F.col("blocks"))
    placed = small.join(plans.select("stratum", "blocks", "rest"), "stratum").withColumn("block", block)
    earlier = Window.partitionBy("stratum").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(
        placed.groupBy("stratum", "block", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))),
        "mix-blocks",
    )
    # The block in which the rest of the target ends, item by item; equal keys stay together.
    last = blocks.where(
        (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    ).select("stratum", "block", "before")
    upto = F.sum("size").over(Window.partitionBy("stratum").orderBy("key"))
    peers = F.sum("size").over(Window.partitionBy("stratum", "key"))
    cut = (
        placed.join(last, ["stratum", "block"])
        .select("stratum", "key", "rest", (2 * (F.col("before") + upto) - peers).alias("twice"))
        .where(F.col("twice") <= 2 * F.col("rest"))
        .groupBy("stratum")
        .agg(F.max("key").alias("cut"))
    )
    ends = last.groupBy("stratum").agg(F.min("block").alias("cut_block"))
    rules = written(
        plans.join(ends, "stratum", "left").join(cut, "stratum", "left"), "mix-rules"
    )
    # Without an item of the last block, the cut is at its start.
    whole = F.col("block") < F.coalesce(F.col("cut_block"), F.lit(-1))
    some = (F.col("block") == F.col("cut_block")) & F.col("cut").isNotNull()
    copies = F.col("epochs") + F.when(whole | some, 1).otherwise(0)
    draws = (
        blocks.select("stratum", "block")
        .join(rules.select("stratum", "epochs", "cut_block", "cut"), "stratum")
        .where(copies > 0)
        .select("stratum", "block", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    )
    shares = written(
        split_draws(draws, shards, seed)
        .groupBy("stratum", "block")
        .agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("shards")),
        "mix-shards",
    )
    return _with_draws(items, rules, shares, seed)


def _with_draws(items: DataFrame, rules: DataFrame, shares: DataFrame, seed: str) -> DataFrame:
    fields = [F.col("_row")[name].alias(name) for name in items.schema["_row"].dataType.names]
    block = slice_of(F.col("_mix.key"), F.col("blocks"))
    more = (F.col("block") < F.coalesce(F.col("cut_block"), F.lit(-1))) | (
        (F.col("block") == F.col("cut_block")) & (F.col("_mix.key") <= F.col("cut"))
    )
    copies = F.col("epochs") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    found = (
        items.withColumn("stratum", F.col("_mix.stratum"))
        .join(rules, "stratum")
        .withColumn("block", block)
        .withColumn("copies", copies)
        .join(shares, ["stratum", "block"], "left")
    )
    draws = F.transform(
        F.slice(F.coalesce(F.col("shards"), F.array().cast(shares.schema["shards"].dataType)), 1, F.col("copies")),
        lambda draw: F.struct(
            draw["shard"].alias("shard"), hash_key(seed, F.col("_mix.key"), draw["copy"]).alias("place")
        ),
    )
    mix: Column = F.struct(
        F.col("_mix.size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("_mix.size") * F.col("copies")).alias("taken"),
        draws.alias("draws"),
    )
    return found.select(*fields, mix.alias("mix"))
