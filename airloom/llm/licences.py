"""Licences in scripts, recognised by their sentences (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import let

#: Sentences of licence texts and notices, normalised (lower case, a space for
#: everything but letters and digits), each with its identifier.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either "
    "express or implied": "apache-disclaimer",
    "see the license for the specific language governing permissions and limitations under the "
    "license": "apache-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to "
    "do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement": "mit-disclaimer",
    "in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software": "mit-liability",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted provided that the above copyright notice and this permission notice "
    "appear in all copies": "isc-grant",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 3 of "
    "the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 2 of "
    "the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without "
    "even the implied warranty of merchantability or fitness for a particular purpose": "gpl-disclaimer",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international "
    "license": "cc-by-nc-4-notice",
    "spdx license identifier mit": "mit-notice",
    "spdx license identifier apache 2 0": "apache-notice",
    "spdx license identifier gpl 3 0 only": "gpl3-notice",
    "spdx license identifier bsd 3 clause": "bsd3-notice",
    "all rights reserved": "all-rights",
}

#: Ordered rules. A licence is recognised where its identifiers follow one another,
#: with no other known sentence between; a shorter rule counts only outside of longer ones.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache-notice", "apache-compliance", "apache-copy", "apache-disclaimer", "apache-see")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-disclaimer", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-disclaimer", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0", ("gpl3-grant", "gpl-disclaimer")),
    ("GPL-2.0", ("gpl2-grant", "gpl-disclaimer")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("ISC", ("isc-grant",)),
    ("all rights reserved", ("all-rights",)),
]

#: Every known sentence has one of these, so that other scripts need not be cut into sentences.
MARKS = r"(?i)licen|permission|warrant|copyright|redistribution|liab|rights reserved"
SENTENCE_END = r"(?<=[.;:!?])\s+|\n"
PARAGRAPH_END = r"(?<=[.;:!?])\s+|\n[\x20\t\r]*\n"


def normalised(sentence: Column) -> Column:
    """Letters and digits of any script in lower case, one space between runs of them."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentence_ids(text: Column, end: str) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*(F.lit(part) for pair in SENTENCES.items() for part in pair))
    # Leading bullets and comment marks fall to the normalisation, a list number does not.
    sentences = F.transform(F.split(text, end), normalised)
    return F.filter(
        F.transform(sentences, lambda sentence: F.try_element_at(known, sentence)),
        lambda name: name.isNotNull(),
    )


def rule_matches(ids: Column) -> Column:
    """The licences whose rules a sequence of identifiers meets; used identifiers count once."""
    state = F.struct(
        F.concat(F.lit("|"), F.concat_ws("||", ids), F.lit("|")).alias("left"),
        F.array().cast("array<string>").alias("found"),
    )

    def apply(rules: list[tuple[str, tuple[str, ...]]], state: Column) -> Column:
        if not rules:
            return F.array_sort(F.array_distinct(state["found"]))
        (licence, parts), rest = rules[0], rules[1:]
        sequence = F.lit("".join(f"|{part}|" for part in parts))
        met = F.contains(state["left"], sequence)
        after = F.struct(
            F.replace(state["left"], sequence, F.lit("#")).alias("left"),
            F.when(met, F.array_append(state["found"], F.lit(licence)))
            .otherwise(state["found"])
            .alias("found"),
        )
        return let(after, lambda new: apply(rest, new))

    return let(state, lambda first: apply(RULES, first))


def licence_scan(
    content: DataFrame, content_id: str = "content_id", script: str = "script"
) -> DataFrame:
    """Which licences every script states, or is under by its text.

    ``(content_id, sentences, licences)``, a row per row of ``content``: the identifiers of known
    licence sentences in order, and the licences whose ordered rules they meet, by name.

    The script is cut into sentences twice, with each line end closing a sentence and with
    blank lines only, so that notices on a line and wrapped licence texts are both found;
    ``sentences`` is from the cut that knows more of them, the lines if equal. Normalised sentences
    are looked up whole. Scripts without a mark that all known sentences share are not cut. NULL and
    empty scripts have no sentences. Everything happens within a row: nothing is shuffled, and
    other columns of ``content`` are left out.
    """
    text = F.coalesce(F.col(script), F.lit(""))
    none = F.array().cast("array<string>")
    marked = text.rlike(MARKS)
    cut = content.select(
        F.col(content_id).alias("content_id"),
        F.when(marked, sentence_ids(text, SENTENCE_END)).otherwise(none).alias("lines"),
        F.when(marked, sentence_ids(text, PARAGRAPH_END)).otherwise(none).alias("paragraphs"),
    )
    either = F.array_sort(
        F.array_distinct(F.concat(rule_matches(F.col("lines")), rule_matches(F.col("paragraphs"))))
    )
    more = F.size("paragraphs") > F.size("lines")
    return cut.select(
        "content_id",
        F.when(more, F.col("paragraphs")).otherwise(F.col("lines")).alias("sentences"),
        F.when((F.size("lines") == 0) & (F.size("paragraphs") == 0), none).otherwise(either).alias("licences"),
    )
