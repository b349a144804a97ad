"""Line dedup by winnowing over line hashes.

A window is a run of lines with 160 characters or 8 lines that has none such inside at its one end: from any line the
shortest run that starts there, and the shortest that ends there (white space around lines does not count).

1. The least line hash of a window, the first among equals, is its fingerprint. Only places of fingerprints are written,
   each once; equal windows have equal fingerprints at the same place in them, so no shared window is missed.
2. Places are joined by their fingerprints; a fingerprint with a single place has no match.
3. The others go back to their texts and are extended before and after the fingerprint to the windows that hold it,
   which match if these are equal to both ends (by 128 bits). Matches that overlap make up maximal runs.
4. All but the first of equal windows, in order of doc_id and place, are later repeats; their lines are deleted. So a
   line is deleted exactly if it is part of a run of 160 characters or 8 lines that occurs earlier.

Null text stays null. Ids are integers; a null doc_id counts as 2^63 - 1, the largest. Rows that share a doc_id are one
document: a run is not repeated for occurring in two of them. Repeated rows get equal results. Extra columns pass
through; n_lines and n_removed replace columns of those names. A text of which every line goes becomes the empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import stage
from millrace.llm.spans import Rule, extended, fingerprints, later_places, repeated, without

RULE = Rule(units=1, chars=160, long_chars=160, most=8)


def lines(text: str) -> list[str]:
    return text.split("\n")


def matched(prints: DataFrame) -> DataFrame:
    """Places whose fingerprint has another place."""
    shared = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("fp")
    return prints.join(stage(shared, "fingerprints"), "fp", "left_semi")


def remove_repeated_lines(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """docs with the cleaned text, n_lines (before) and n_removed."""
    prints = stage(fingerprints(docs, lines, rule), "prints")
    windows = stage(extended(docs, matched(prints), lines, rule), "windows")
    return without(docs, later_places(windows, repeated(windows, "runs")), lines, "\n", "lines")
