"""Exposures and the conversions that follow them within a bound of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.timing import epoch_seconds, seconds_between, time_type
from airloom.operators.slices import require

BUCKET = "_bucket"


def conversions_within(
    exposures: DataFrame,
    conversions: DataFrame,
    key: str,
    ts: str,
    within_s: int,
    event_id: str = "event_id",
) -> DataFrame:
    """Every pair of an exposure and a conversion of one key at most ``within_s`` seconds later.

    ``(key, exposure_id, exposed_at, conversion_id, converted_at, lag_s)``; a conversion at the very time of
    the exposure counts. Rows without a key or time meet nothing; repeated rows are rows of
    their own. The join is on stretches of time next to the key, so a hot key is spread
    over many tasks: an exposure is listed under its own stretch and the next, a conversion under its own.
    """
    return lagged(meetings(exposures, conversions, key, ts, within_s, event_id), key)


def meetings(
    exposures: DataFrame, conversions: DataFrame, key: str, ts: str, within_s: int, event_id: str
) -> DataFrame:
    """The pairs, of batches or of streams with watermarks on ``ts``."""
    if within_s < 1:
        raise ValueError("the bound is at least one second")
    if time_type(exposures, ts) != time_type(conversions, ts):
        raise ValueError(f"{ts!r} must be of one type on both sides")

    def side(df: DataFrame, id: str, at: str, stretches: int) -> DataFrame:
        stretch = F.floor(epoch_seconds(df, ts) / F.lit(within_s))
        listed = F.sequence(stretch, stretch + F.lit(stretches - 1))
        known = require(df, key, ts)
        return known.select(
            F.col(key).alias(f"_{id}_key"),
            F.col(event_id).alias(id),
            F.col(ts).alias(at),
            F.explode(listed).alias(f"_{id}_stretch"),
        )

    shown = side(exposures, "exposure_id", "exposed_at", 2)
    bought = side(conversions, "conversion_id", "converted_at", 1)
    bound = F.expr(f"INTERVAL {within_s} SECONDS")
    same = (F.col("_exposure_id_key") == F.col("_conversion_id_key")) & (
        F.col("_exposure_id_stretch") == F.col("_conversion_id_stretch")
    )
    later = (F.col("converted_at") >= F.col("exposed_at")) & (F.col("converted_at") <= F.col("exposed_at") + bound)
    return shown.join(bought, same & later)


def lagged(pairs: DataFrame, key: str) -> DataFrame:
    lag = seconds_between(F.col("exposed_at"), F.col("converted_at")).cast("double")
    return pairs.select(
        F.col("_exposure_id_key").alias(key),
        "exposure_id",
        "exposed_at",
        "conversion_id",
        "converted_at",
        lag.alias("lag_s"),
    )
