"""The JSON payload of events: typed parsing and maps merged per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.operators.skew import SALTS


def parsed_props(events: DataFrame, props: str = "props") -> DataFrame:
    """``events`` with ``prop_values``, ``prop_numbers`` and ``broken``.

    ``prop_values`` is a map from the top-level names of the payload to their values: texts as they
    are, others as JSON. ``prop_numbers`` holds those that are finite numbers, also if written as
    text. ``broken`` marks payloads that are not a JSON object; both maps are then NULL, as they are
    for a NULL payload, which is not broken. A repeated name has its last value; a JSON ``null``
    stays as NULL in the values. Columns of these names are replaced.
    """
    payload = F.col(props)
    values = F.from_json(payload, "map<string,string>", {"mode": "PERMISSIVE"})
    # Only a whole document that parses counts, not one that stops in the middle.
    whole = F.try_parse_json(payload).isNotNull() & payload.rlike(r"^\s*\{")
    known = F.when(whole, values)
    number = F.transform_values("prop_values", lambda _, value: value.try_cast("double"))
    finite = F.map_filter(
        number, lambda _, value: value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    )
    return (
        events.withColumn("prop_values", known)
        .withColumn("prop_numbers", finite)
        .withColumn("broken", payload.isNotNull() & F.col("prop_values").isNull())
    )


def merged_props(
    events: DataFrame,
    key: str,
    ts: str,
    event_id: str = "event_id",
    props: str = "props",
) -> DataFrame:
    """The payloads of each key as one: ``(key, latest, totals, times, events, broken)``.

    Per name, ``latest`` has the newest value by time and id, also if it is NULL; ``totals`` the sum of its
    numbers, as decimals to six places, which add up alike in any order; ``times`` how often it was given.
    ``events`` and ``broken`` count the events of the key, and those whose payload is no JSON
    object. Every key has a row; one without a name has empty maps. Rows without a key are left out.

    Names are aggregated by key, name and a salt first, so a hot key does not meet in one task, and
    put together into maps last: a key has as many entries as it has different names.
    """
    parsed = parsed_props(events.where(F.col(key).isNotNull()).select(key, ts, event_id, props), props)
    # An event without a name keeps a row, so that its key is not lost.
    named = parsed.select(
        key,
        F.col(ts).alias("_ts"),
        F.col(event_id).alias("_id"),
        "broken",
        F.col("prop_numbers").alias("_numbers"),
        F.posexplode_outer(F.map_entries("prop_values")).alias("_place", "_entry"),
    )
    name = F.col("_entry.key")
    rows = named.select(
        key,
        name.alias("_name"),
        F.struct("_ts", "_id", F.col("_entry.value").alias("value")).alias("_given"),
        F.get(F.map_values(F.map_filter("_numbers", lambda other, _: other == name)), F.lit(0))
        .cast("decimal(28,6)")
        .alias("_number"),
        # Counted once, by the first name of an event or the row that stands for none.
        (F.coalesce("_place", F.lit(0)) == 0).cast("int").alias("_first"),
        "broken",
        F.pmod(F.xxhash64("_id", "_ts"), F.lit(SALTS)).alias("_salt"),
    )
    measures = {
        "_given": F.max("_given"),
        "_number": F.sum("_number"),
        "_times": F.count(F.lit(1)),
        "_first": F.sum("_first"),
        "_broken": F.sum(F.col("broken").cast("int")),
    }
    salted = rows.groupBy(key, "_name", "_salt").agg(*(m.alias(n) for n, m in measures.items()))
    again = {
        "_given": F.max("_given"),
        **{n: F.sum(n) for n in ("_number", "_times", "_first", "_broken")},
    }
    names = salted.groupBy(key, "_name").agg(*(m.alias(n) for n, m in again.items()))

    def as_map(value: Column) -> Column:
        listed = F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_name", value.alias("v"))))
        return F.map_from_entries(F.sort_array(listed))

    return names.groupBy(key).agg(
        as_map(F.col("_given.value")).alias("latest"),
        F.map_filter(as_map(F.col("_number")), lambda _, total: total.isNotNull()).alias("totals"),
        as_map(F.col("_times")).alias("times"),
        F.sum("_first").alias("events"),
        F.sum("_broken").alias("broken"),
    )
