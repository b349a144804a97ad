"""Claim verification against cited evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import numbers, tokens

#: Words that do not count as overlap (fixed values).
STOPWORDS = ["about", "after", "also", "and", "are", "because", "been", "being", "but", "can", "for", "from", "has", "have", "into", "not", "of", "only", "that", "the", "their", "this", "tender", "to", "with", "you", "your"]
#: Text that tries to steer a model (fixed pattern).
MALICIOUS = r"(?i)ignore all previous|system prompt|fake:\d+|<untrusted"
#: Words that state a decision (fixed values).
DECISIONS = r"\b(?:BID|NO_BID|REVIEW|INSUFFICIENT_EVIDENCE)\b"


#: Parts of an evidence row that a claim may rest on, in this order; tool_evidence is what a decision tool returned.
PARTS = ("text", "excerpt", "title", "buyer", "tool_evidence")


def evidence_text(evidence: DataFrame) -> Column:
    """All parts that the evidence has, as one text."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in PARTS if c in evidence.columns])


def verify_claims(answers: DataFrame, evidence: DataFrame, overlap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(claims with their checks, one row per answer).

    answers (answer_id, claims array<struct<text, evidence_ids>>), evidence (evidence_id, is_decision and any of PARTS). A claim is
    supported if it cites at least one id, all are known, half its tokens and all its numbers and decision words occur
    in the cited evidence, and it carries no injected instruction.
    """
    claims = answers.select("answer_id", F.posexplode_outer("claims").alias("pos", "c")).select("answer_id", "pos", "c.text", "c.evidence_ids").filter(F.col("pos").isNotNull())
    cited = claims.select("answer_id", "pos", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    parts = evidence.select("evidence_id", "is_decision", evidence_text(evidence).alias("etext"))
    known = cited.join(parts, "evidence_id", "left").groupBy("answer_id", "pos").agg(
        F.count(F.lit(1)).alias("n_cited"), F.count("etext").alias("n_known"), F.coalesce(F.bool_or("is_decision"), F.lit(False)).alias("decision"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "etext"))), lambda x: x["etext"]), " ").alias("etext"),
    )
    rows = claims.join(known, ["answer_id", "pos"], "left").fillna({"n_cited": 0, "n_known": 0, "etext": "", "decision": False})
    mine = tokens("text", STOPWORDS)
    share = F.size(F.array_intersect(mine, tokens("etext", STOPWORDS))) / F.greatest(F.size(mine), F.lit(1))
    said = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(DECISIONS), F.lit(0)))
    decided = (F.size(said) == 0) | (F.col("decision") & F.forall(said, lambda w: F.upper("etext").contains(w)))
    numeric = F.size(F.array_except(numbers("text"), numbers("etext"))) == 0
    supported = (F.col("n_cited") > 0) & (F.col("n_known") == F.col("n_cited")) & (share >= overlap) & numeric & decided & ~F.col("text").rlike(MALICIOUS)
    rows = rows.withColumn("supported", F.coalesce(supported, F.lit(False)))
    per = rows.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("supported").alias("supported"), F.sum("n_cited").alias("cited"), F.sum("n_known").alias("known"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("pos", "text", "evidence_ids")))), lambda c: F.concat(c["text"], F.lit(" "), F.array_join(F.transform(c["evidence_ids"], lambda e: F.concat(F.lit("["), e, F.lit("]"))), " "))), " ").alias("answer"),
    )
    rates = {"support_rate": F.round(F.col("supported") / F.col("claims"), 6), "citation_validity": F.when(F.col("cited") > 0, F.round(F.col("known") / F.col("cited"), 6)).otherwise(1.0)}
    return rows, per.withColumns(rates | {"status": F.when(F.col("supported") > 0, "ANSWERED").otherwise("INSUFFICIENT_EVIDENCE")})
