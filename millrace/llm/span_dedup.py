"""Substring dedup on sliding spans of sentences.

A text is cut after '.', '!', '?' and line ends. A span is a run of consecutive sentences that is long enough: 3
sentences and 100 characters, or 200 characters (one long sentence may do), or 12 sentences; white space around
sentences does not count. Of each sentence the shortest span from it and the shortest span to it are hashed; longer
spans are unions of these. Spans are joined over all documents by their hash, and every sentence covered by a span
that is not the first of its kind, in order of doc_id and place, is removed. So a sentence is removed exactly if it
is part of a span that occurs earlier.

Null text stays null and has no sentences to remove; empty text likewise. Ids are integers; a null doc_id
counts as 2^63 - 1, the largest. Rows that share a doc_id are one document: a span is not repeated for occurring in two of them.
Repeated rows get equal results. Extra columns pass through; n_sentences and n_removed replace columns of those
names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from millrace.llm.spans import Rule, later_places, places, repeated, without

RULE = Rule(units=3, chars=100, long_chars=200, most=12)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*")


def sentences(text: str) -> list[str]:
    """Pieces that make up the text again when joined."""
    return _SENTENCE.findall(text)


def remove_repeated_spans(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """docs with the cleaned text, n_sentences (before) and n_removed."""
    spans = places(docs, sentences, rule)
    return without(docs, later_places(spans, repeated(spans, "spans")), sentences, "", "sentences")
