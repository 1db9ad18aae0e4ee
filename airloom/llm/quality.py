"""Quality rules whose limits follow from the data (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.llm.common import WORD_GAP, let, words_of, written

MIN_WORDS = 50
#: Signals with a limit, and the least spread (in their unit) that a limit allows for.
SIGNALS = {"symbol_share": 10, "dup_line_share": 50, "repeat_share": 50, "word_length": 40}
FENCE = 3


def script_signals(
    content: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    language: str = "language",
    blogger: str = "blogger",
) -> DataFrame:
    """Counts over the whole script of every content item.

    ``(content_id, language, blogger, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words)``. Words are what ASCII white space separates. ``n_lines`` counts lines with a
    word, ``n_dup_lines`` those equal to an earlier one, and ``n_repeat_words`` the words inside
    windows of three words that the script has more than once. NULL and empty scripts count 0.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = content.select(
        F.col(content_id).alias("content_id"),
        F.col(language).alias("language"),
        F.col(blogger).alias("blogger"),
        F.col(script).alias("_text"),
    )
    return rows.select(
        "content_id",
        "language",
        "blogger",
        let(
            words_of(F.col("_text")),
            lambda words: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                _repeated_words(words).cast("bigint").alias("n_repeat_words"),
            ),
        ).alias("_words"),
        F.length(F.regexp_replace(text, WORD_GAP, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")))
        .cast("bigint")
        .alias("n_symbols"),
        let(
            lines,
            lambda found: F.struct(
                F.size(found).cast("bigint").alias("n_lines"),
                (F.size(found) - F.size(F.array_distinct(found))).cast("bigint").alias("n_dup"),
            ),
        ).alias("_lines"),
    ).select(
        "content_id",
        "language",
        "blogger",
        "_words.n_words",
        "word_chars",
        "n_symbols",
        "_lines.n_lines",
        F.col("_lines.n_dup").alias("n_dup_lines"),
        "_words.n_repeat_words",
    )


def _repeated_words(words: Column) -> Column:
    """Words covered by windows of three that occur again, in n log n steps.

    Windows are compared by a 64-bit hash: sorted by it, equal ones are neighbours.
    """
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(
        F.array().cast("array<int>")
    )
    windows = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
            i.alias("i"),
        ),
    )

    def repeated(ordered: Column) -> Column:
        def same(i: Column, other: Column) -> Column:
            return F.coalesce(F.get(ordered, other)["h"] == F.get(ordered, i)["h"], F.lit(False))

        marked = F.transform(
            ordered,
            lambda window, i: F.when(same(i, i - 1) | same(i, i + 1), window["i"]),
        )
        return F.sort_array(F.array_compact(marked))

    def covered(places: Column) -> Column:
        new = F.transform(
            places,
            lambda place, i: F.least(
                F.lit(3), F.coalesce(F.get(places, i + 1) - place, F.lit(3))
            ),
        )
        return F.aggregate(new, F.lit(0), lambda total, n: total + n)

    return let(F.sort_array(windows), lambda ordered: let(repeated(ordered), covered))


def sketch_bin(value: Column) -> Column:
    """The lower edge of a value's bin: exact below 64, then 32 bins for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def quantile_sketches(signals: DataFrame) -> DataFrame:
    """A mergeable quantile sketch per language, blogger and signal.

    ``(language, blogger, signal, bin, n)``: how many values lie in each bin of relative width
    1/32. Sketches merge by adding ``n``, in any order and with the same result, so they are
    combined before the shuffle and again from bloggers to languages to all content.
    """
    values = F.array(
        *(F.struct(F.lit(name).alias("signal"), F.col(name).alias("bin")) for name in SIGNALS)
    )
    return (
        signals.select("language", "blogger", F.explode(values).alias("v"))
        .groupBy("language", "blogger", F.col("v.signal").alias("signal"), F.col("v.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketches.groupBy(*keys, "signal", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "signal")
    counted = merged.select(
        *keys,
        "signal",
        "bin",
        F.sum("n").over(group.orderBy("bin")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    return counted.groupBy(*keys, "signal").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
    )


def adaptive_limits(sketches: DataFrame, min_rows: int = 200) -> DataFrame:
    """Limits per language and blogger: the quartiles widened by three times their distance.

    ``(language, blogger, <signal>_low, <signal>_high)``. A blogger with fewer than
    ``min_rows`` scripts in a language takes the limits of the language, and a language with
    fewer those of all content; NULL is a language and a blogger of its own.
    """
    levels = [["language", "blogger"], ["language"], []]
    groups = sketches.select("language", "blogger", "signal").distinct()
    for number, keys in enumerate(levels):
        found = _quartiles(sketches, keys).select(
            *(F.col(key).alias(f"_{key}") for key in keys),
            F.col("signal").alias("_signal"),
            F.struct("total", "q1", "q3").alias(f"level{number}"),
        )
        on = F.col("signal") == F.col("_signal")
        for key in keys:
            on = on & F.col(key).eqNullSafe(F.col(f"_{key}"))
        groups = groups.join(found, on, "left").drop("_signal", *(f"_{key}" for key in keys))
    chosen = F.when(F.col("level0.total") >= min_rows, F.col("level0")).when(
        F.col("level1.total") >= min_rows, F.col("level1")
    ).otherwise(F.col("level2"))
    least = F.lit(0)
    for name, spread in SIGNALS.items():
        least = F.when(F.col("signal") == name, spread).otherwise(least)
    quartiles = groups.select("language", "blogger", "signal", chosen.alias("q"), least.alias("least"))
    reach = FENCE * F.greatest(F.col("q.q3") - F.col("q.q1"), F.col("least"))
    limits = quartiles.select(
        "language", "blogger", "signal",
        (F.col("q.q1") - reach).alias("low"), (F.col("q.q3") + reach).alias("high"),
    )
    return limits.groupBy("language", "blogger").agg(
        *(
            F.max(F.when(F.col("signal") == name, F.col(side))).alias(f"{name}_{side}")
            for name in SIGNALS
            for side in ("low", "high")
        )
    )


def quality_rules(
    content: DataFrame,
    content_id: str = "content_id",
    script: str = "script",
    language: str = "language",
    blogger: str = "blogger",
    min_rows: int = 200,
) -> DataFrame:
    """Which scripts are of usual quality among those of their language and blogger.

    Adds to :func:`script_signals` the signals (shares in thousandths, mean word length in
    hundredths), ``base_failed`` (fewer than 50 words, or more than half of them repeated) and
    ``kept``: not failed, and within the adaptive limits of the group. The limits come from
    quantile sketches of the scripts that did not fail; low limits hold for the word length only.

    One row per row of ``content``. NULL and empty scripts fail. Rows with equal ids are judged
    each for itself. Other columns of ``content`` are not looked at.
    """
    counted = script_signals(content, content_id, script, language, blogger)
    share = lambda part, whole: F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    signals = written(
        counted.withColumns(
            {
                "symbol_share": share("n_symbols", "word_chars"),
                "dup_line_share": share("n_dup_lines", "n_lines"),
                "repeat_share": share("n_repeat_words", "n_words"),
                "word_length": F.floor(
                    100 * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
                ),
                "base_failed": (F.col("n_words") < MIN_WORDS)
                | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            }
        ).withColumns({name: sketch_bin(F.col(name)) for name in SIGNALS}),
        "quality-signals",
    )
    sketches = written(quantile_sketches(signals.where(~F.col("base_failed"))), "quality-sketches")
    limits = written(adaptive_limits(sketches, min_rows), "quality-limits").select(
        F.col("language").alias("_language"),
        F.col("blogger").alias("_blogger"),
        *(f"{name}_{side}" for name in SIGNALS for side in ("low", "high")),
    )
    usual = F.col("word_length") >= F.col("word_length_low")
    for name in SIGNALS:
        usual = usual & (F.col(name) <= F.col(f"{name}_high"))
    same = F.col("language").eqNullSafe(F.col("_language")) & F.col("blogger").eqNullSafe(
        F.col("_blogger")
    )
    return (
        signals.join(limits, same, "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(usual, F.lit(True)))
        .drop("_language", "_blogger", *(f"{n}_{side}" for n in SIGNALS for side in ("low", "high")))
    )
