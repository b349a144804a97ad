"""Texts are read once for all requirements, and a certificate's sentence is found in linear time."""

import re
import time

from pyspark.sql import functions as F

from millrace.operators import eforms, tenders

TEXTS = [
    "Bidders must hold ISO 9001. Minimum annual turnover of 5 000 EUR! At least 3 references. ISO 14001:2015 is welcome",
    "ISO9001", "First. Second? The ISO 27001 must hold! More.", "No requirement.", None, "Shall we speak English and French? ISO 9001, again ISO 9001 must.",
    "At least 12 reference projects.\nISO 9001\nrequired by all of the bidders who take part.",
]


def test_certificates_have_their_sentence(spark):
    lots = spark.createDataFrame([("n", f"LOT-{i}", t) for i, t in enumerate(TEXTS)], "notice_id string, lot_id string, description string")
    asked, _, evidence = tenders.extract_requirements(lots)
    got = sorted((r.lot_id, r.text, r.value_str) for r in asked.filter("category = 'certification'").collect())
    expected = []
    for i, text in enumerate(TEXTS):
        for m in re.finditer(r"(?i)\b(ISO\s?\d{4,6}(?::\d{4})?)\b", text or ""):
            sentence = re.search(rf"(?s)[^.!?]*?{re.escape(m[1])}[^.!?]*[.!?]?", text)[0].strip(" ")
            expected.append((f"LOT-{i}", sentence, re.sub(r"^ISO\s?", "ISO ", m[1].upper())))
    assert got == sorted(expected)
    ids = [r.evidence_id for r in asked.collect()]
    assert sorted(ids) == sorted(r.evidence_id for r in evidence.collect()) and len(set(ids)) == len(ids)
    assert sorted(int(r.requirement_id.rsplit(":", 1)[1]) for r in asked.collect()) == list(range(1, len(ids) + 1))


def test_requirements_of_a_lot_without_id_have_evidence(spark):
    lots = spark.createDataFrame([("n", None, "The supplier must hold ISO 9001 at all times. Bidders must have an office nearby.")], "notice_id string, lot_id string, description string")
    asked, _, evidence = tenders.extract_requirements(lots)
    assert asked.count() == evidence.count() == 2


def test_long_sentences_take_linear_time(spark):
    lots = spark.createDataFrame([("n", "LOT-1", "word " * 30_000 + "ISO 9001 must hold.")], "notice_id string, lot_id string, description string")
    began = time.monotonic()
    assert tenders.extract_requirements(lots)[0].filter("category = 'certification'").count() == 1
    assert time.monotonic() - began < 20


def test_plans_read_their_lots_once(spark):
    """Requirements and evidence are read from what was written: their plans do not grow with the families."""
    lots = spark.range(3).select(F.lit("n").alias("notice_id"), F.concat(F.lit("LOT-"), F.col("id")).alias("lot_id"), F.lit("ISO 9001 must hold.").alias("description"), F.lit("u").alias("xml_url"))
    asked, _, evidence = tenders.extract_requirements(lots)
    out = eforms.enrich(lots, asked, lots.select("notice_id", F.lit("<N/>").alias("xml")))
    for frame, most in ((asked, 1), (evidence, 2), (out["requirements"], 5), (out["evidence"], 6)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Range" not in plan and sum("Relation" in line for line in plan.splitlines()) <= most
