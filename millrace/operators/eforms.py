"""Lots, selection and award criteria from the XML of procurement notices.

Elements are found by their local names at any depth. XML functions take a fixed path and parse the text for each of
them, so a task parses a document once, as a tree, and reads all from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.tenders import extract_requirements
from millrace.sources.shared import shuffled, stage

LOT_CHARS, EXCERPT_CHARS = 12_000, 1000
#: Words of a selection criterion that give its category (fixed values), the first that occurs.
CATEGORY_WORDS = {"turnover": ["turnover", "financial", "fin-sta"], "professional": ["register", "professional", "suit-reg"], "references": ["reference", "experience", "past contract"], "staff": ["staff", "personnel"]}
SOURCE = "TED eForms XML"
#: Documents of which a task holds what they say at once.
DOCUMENTS = 256
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Columns of an award criterion and the elements that they are read from.
_AWARD = {"Name": "name", "AwardingCriterionTypeCode": "type", "ParameterNumeric": "number", "ParameterCode": "weight_type", "Description": "description"}
_PARTS = {"selections": ("code", "text"), "awards": tuple(_AWARD.values())}
_LOTS = pa.list_(pa.struct({"lot_id": pa.string(), "texts": pa.list_(pa.string())} | {k: pa.list_(pa.struct([(c, pa.string()) for c in v])) for k, v in _PARTS.items()}))
_LOTS_DDL = f"array<struct<lot_id: string, texts: array<string>, {', '.join(f'{k}: array<struct<{", ".join(f"{c}: string" for c in v)}>>' for k, v in _PARTS.items())}>>"


@cache
def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _tree(xml: str) -> ElementTree.Element:
    """The elements under their local names; prefixes need no declaration, comments are left out."""
    parser, tree = expat.ParserCreate(), ElementTree.TreeBuilder()
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attributes: tree.start(_local(name), attributes)
    parser.EndElementHandler = lambda name: tree.end(_local(name))
    parser.CharacterDataHandler = tree.data
    parser.Parse(xml, True)
    return tree.close()


def _texts(element: ElementTree.Element) -> list[str]:
    """The texts in an element, white space joined, without empty ones, in the order of the document."""
    found = element.itertext() if len(element) else (element.text or "",)
    return [text for t in found if (text := _SPACE.sub(" ", t).strip(" "))]


def _firsts(piece: ElementTree.Element, names: dict[str, str]) -> dict[str, str]:
    """The first text of elements of these names, each under its column."""
    out: dict[str, str] = {}
    for x in piece.iter():
        if (column := names.get(x.tag)) and column not in out and (texts := _texts(x)):
            out[column] = texts[0]
    return out


def _selection(piece: ElementTree.Element) -> dict[str, str]:
    codes = (t.strip(" ") for x in piece.iter("TendererRequirementTypeCode") if x.get("listName") == "selection-criterion" for t in (x.text, *(y.tail for y in x)) if t)
    return _firsts(piece, {"Description": "text"}) | ({"code": code} if (code := next(filter(None, codes), None)) else {})


def _lot(lot: ElementTree.Element) -> dict:
    ids, texts, selections, awards = [], {}, [], []
    for x in lot.iter():
        if x.tag == "ID":
            ids += [t for t in _texts(x) if t.startswith("LOT-")]
        elif x.tag in ("Description", "Note"):
            texts |= dict.fromkeys(_texts(x))
        elif x.tag == "SelectionCriteria":
            selections.append(_selection(x))
        elif x.tag == "SubordinateAwardingCriterion":
            awards.append(_firsts(x, _AWARD))
    return {"lot_id": ids[0] if ids else None, "texts": list(texts), "selections": [x for x in selections if x], "awards": [x for x in awards if x.keys() & {"name", "type", "description"}]}


def _said(xml: str | None) -> tuple[str | None, list[dict] | None]:
    """(reason, lots) of a document, one of them null."""
    if xml is None:
        return "NO_XML", None
    start = xml[:4096].lower()
    if "<!doctype" in start or "<!entity" in start:
        return "UNSAFE_XML", None
    try:
        lots = map(_lot, _tree(xml).iter("ProcurementProjectLot"))
    except expat.ExpatError:
        return "INVALID_XML", None
    return None, [x for x in lots if x["lot_id"] is not None]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(notice_id, reason, lots) of batches (notice_id, xml)."""
    for batch in batches:
        for at in range(0, len(batch), DOCUMENTS):
            part = batch.slice(at, DOCUMENTS)
            said = [_said(xml) for xml in part.column("xml").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("notice_id"), pa.array([r for r, _ in said], pa.string()), pa.array([x for _, x in said], _LOTS)], ["notice_id", "reason", "lots"])


def category() -> Column:
    said = F.lower(F.concat_ws(" ", "code", "text"))
    words = [F.when(F.exists(F.array(*map(F.lit, w)), lambda x: said.contains(x)), k) for k, w in CATEGORY_WORDS.items()]
    return F.coalesce(*words, F.lit("technical"))


def read_lots(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lots, rejected) of documents (notice_id, xml).

    lots: notice_id, lot_id, texts, selections array<struct<code, text>>, awards array<struct<name, type, weight,
    weight_type, description>>. Documents with a type or entity declaration, or that can't be parsed, are rejected with a reason.
    """
    kind = dict(documents.dtypes)["notice_id"]
    read = documents.select("notice_id", "xml").mapInArrow(_read, f"notice_id {kind}, reason string, lots {_LOTS_DDL}")

    def chosen(s: Column) -> Column:
        return F.struct(F.coalesce(s["code"], F.lit("selection-criterion")).alias("code"), F.coalesce(s["text"], s["code"]).alias("text"))

    def weighed(a: Column) -> Column:
        weight = F.regexp_replace(F.regexp_replace(a["number"], " ", ""), ",", ".").try_cast("double").alias("weight")
        return F.struct(F.coalesce(a["name"], a["type"], F.lit("Award criterion")).alias("name"), F.coalesce(a["type"], F.lit("other")).alias("type"), weight, a["weight_type"].alias("weight_type"), F.coalesce(a["description"], F.lit("")).alias("description"))

    lots = read.filter("reason is null").select("notice_id", F.inline("lots"))
    lots = lots.withColumns({"selections": F.transform("selections", chosen), "awards": F.transform("awards", weighed)})
    return lots, read.filter("reason is not null").select("notice_id", "reason")


def enrich(lots: DataFrame, requirements: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """lots, requirements, awards, findings and evidence of notices with what their XML says.

    lots (notice_id, lot_id, description, xml_url and more), requirements as extract_requirements makes them, some from
    other sources. A lot's description grows by its XML texts, up to LOT_CHARS. Requirements of the XML come before
    those of other fields, which they replace where lot (or no lot) and text are equal; those from descriptions are
    read anew. Lots that only the XML has are left out.
    """
    parsed, rejected = read_lots(documents)
    # written where they meet: texts, selections and awards are read again each
    xml = stage(parsed.join(shuffled(lots.select("notice_id", "lot_id", "xml_url")), ["notice_id", "lot_id"]), "xml-lots")
    told = F.substring(F.array_join("texts", "\n"), 1, LOT_CHARS)
    texts = xml.select("notice_id", "lot_id", "xml_url", told.alias("told")).filter("told <> ''")
    grown = F.substring(F.concat(F.coalesce("description", F.lit("")), F.lit("\n"), F.col("told")), 1, LOT_CHARS)
    new_lots = lots.join(shuffled(texts.select("notice_id", "lot_id", "told")), ["notice_id", "lot_id"], "left").withColumn("description", F.when(F.col("told").isNull(), F.col("description")).otherwise(grown)).drop("told").select(*lots.columns)

    key = F.concat(F.lit("ted:"), "notice_id", F.lit(":"), "lot_id")
    number = F.row_number().over(Window.partitionBy("notice_id").orderBy("lot_id", "pos"))
    chosen = xml.select("notice_id", "lot_id", "xml_url", F.posexplode("selections").alias("pos", "s")).withColumn("n", number).select("*", "s.code", "s.text")
    selected = chosen.select(
        F.concat_ws(":", "notice_id", F.lit("xml-selection"), "n").alias("requirement_id"), "notice_id", "lot_id", category().alias("category"), "text", F.lit("eligibility").alias("requirement_type"), F.lit(True).alias("mandatory"),
        F.lit("UNKNOWN").alias("stage"), F.lit("eforms:SelectionCriteria").alias("source_field"), F.concat(key, F.lit(":xml-selection-"), "n").alias("evidence_id"), F.lit(1.0).alias("confidence"), F.lit("STRUCTURED").alias("extraction_status"), "xml_url",
    )
    awards = xml.select("notice_id", "lot_id", "xml_url", F.posexplode("awards").alias("pos", "a")).withColumn("n", number).select(
        F.concat_ws(":", "notice_id", F.lit("xml-award"), "n").alias("criterion_id"), "notice_id", "lot_id", "a.*", F.concat(key, F.lit(":xml-award-"), "n").alias("evidence_id"), "xml_url"
    )

    said = selected.select("notice_id", "lot_id", "text").distinct()
    other = requirements.filter("source_field <> 'description-lot'")
    with_lot = other.filter("lot_id is not null").join(shuffled(said), ["notice_id", "lot_id", "text"], "left_anti").select(*other.columns)
    without = other.filter("lot_id is null").join(shuffled(said.select("notice_id", "text").distinct()), ["notice_id", "text"], "left_anti").select(*other.columns)
    prose, findings, prose_evidence = extract_requirements(new_lots)
    every = selected.drop("xml_url").unionByName(with_lot, allowMissingColumns=True).unionByName(without, allowMissingColumns=True).unionByName(prose, allowMissingColumns=True)

    excerpt = lambda c: F.substring(c, 1, EXCERPT_CHARS).alias("excerpt")
    row = lambda df, i, field, text: df.select(i.alias("evidence_id"), "notice_id", "lot_id", F.lit(field).alias("field"), excerpt(text), F.col("xml_url").alias("source_url"), F.lit(SOURCE).alias("source"))
    evidence = row(texts, F.concat(key, F.lit(":document:xml")), "procurement_document", F.col("told")).unionByName(row(selected, F.col("evidence_id"), "selection_criterion", F.col("text")))
    evidence = evidence.unionByName(row(awards, F.col("evidence_id"), "award_criterion", F.concat_ws(": ", "name", "description"))).unionByName(prose_evidence)
    return {"lots": new_lots, "requirements": every, "awards": awards.drop("xml_url"), "findings": findings, "evidence": evidence, "rejected": rejected}
