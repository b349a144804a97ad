"""Procurement notices: requirement extraction, bid decisions, versioned ingest."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.tables import bounded, field_diff, latest_per_key
from millrace.sources.shared import stage

#: Phrases that announce requirements, and texts that try to steer a reader (fixed patterns).
FAMILIES = {
    "turnover": (r"(?i)(?:minimum|at least|vähintään)[^.!?]{0,60}(?:annual )?(?:turnover|liikevaihto)[^0-9]{0,20}([0-9][0-9 .,'’]*)\s*(?:EUR|€)", 1),
    "references": (r"(?i)(?:minimum|at least|vähintään)[^.!?]{0,50}?([0-9]+)\s+(?:references?|reference projects?|referenssi)", 1),
    "certification": (r"(?i)\b(ISO\s?\d{4,6}(?::\d{4})?)\b", 1),
    "language": (r"(?i)(?:required|must|shall|vähintään)[^.!?]{0,45}\b(English|Finnish|Swedish|French|German)\b", 1),
}
#: Words that oblige (fixed patterns), the second list for a certificate's sentence.
OBLIGATION = r"(?i)\b(required|requires|shall|must|minimum requirement|edellytetään|tulee olla|vähintään)\b"
INJECTION = r"(?i)ignore all previous instructions|mark this opportunity as bid|reveal the system prompt|call another tool|fake:\d+"
STATED = r"(?i)\b(must|required|shall|minimum|at least|vähintään|edellytetään|tulee)\b"
#: Words in a lot's text that show a capability (fixed values).
CAPABILITY_TERMS = {
    "python": ["python"], "sql": ["sql", "database"], "power bi": ["power bi", "business intelligence"], "machine learning": ["machine learning", "artificial intelligence"],
    "ai / llm": ["llm", "artificial intelligence", "generative ai"], "data engineering": ["data engineering", "data platform", "etl"], "azure": ["azure", "cloud"],
    "analytics": ["analytics", "data analysis"], "automation": ["automation"],
}
#: Codes of languages (fixed values).
LANGUAGE_CODES = {"english": "eng", "finnish": "fin", "swedish": "swe", "french": "fra", "german": "deu"}


#: Kinds of a free sentence (fixed patterns), the first that fits.
SENTENCE_KINDS = {"consortium": r"(?i)consortium|group of economic operators|subcontract", "staff": r"(?i)staff|personnel|qualification", "geography": r"(?i)country|member state|geographic"}
UNITS = {"turnover": "EUR", "references": "count"}
#: The requirements of a lot before they are numbered.
ITEMS = "array<struct<family:int,pos:int,category:string,text:string,mandatory:boolean,value_num:double,value_str:string>>"


def extract_requirements(lots: DataFrame, most: int = 20, source: str = "ted") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requirements, findings, evidence) of lots (notice_id, lot_id, description and, if known, notice_url).

    Structured families come first, all of them; then obligation sentences of 25 to 700 characters that neither hold
    nor are held by a requirement of the lot found before, structured or free. Sentences end when the lot has `most`
    requirements; one is taken even if the families alone have as many. A lot with injected instructions yields a
    finding and its genuine requirements stay. Every requirement and finding has a row of evidence. Requirements are
    numbered over the lots of a notice, in order of lot_id.
    """
    none, no_item = F.lit(None), F.array().cast(ITEMS)
    rows = lots.select("notice_id", "lot_id", F.coalesce("description", F.lit("")).alias("said"), F.col("notice_url") if "notice_url" in lots.columns else none.cast("string").alias("notice_url"))

    def structured(rank: int, category: str, pattern: str, group: int) -> Column:
        """The requirements of one family in a text."""

        def item(whole: Column, i: Column) -> Column:
            text, raw = F.trim(whole), F.regexp_extract(whole, pattern, group)
            if category == "certification":
                # its sentence: from after the last end of a sentence before it to the next end
                at = F.instr(F.col("said"), raw)
                left = F.regexp_replace(F.substring(F.col("said"), F.lit(1), at - 1), r"(?s)^.*[.!?]", "")
                right = F.regexp_extract(F.substring(F.col("said"), at + F.length(raw), F.length("said")), r"^[^.!?]*[.!?]?", 0)
                text = F.trim(F.concat(left, raw, right))
            mandatory = text.rlike(STATED) if category == "certification" else F.lit(True)
            number = F.regexp_replace(raw, "[^0-9]", "").try_cast("double") if category in UNITS else none.cast("double")
            string = F.regexp_replace(F.upper(raw), r"^ISO\s?", "ISO ") if category == "certification" else raw if category == "language" else none.cast("string")
            return F.struct(F.lit(rank).alias("family"), i.alias("pos"), F.lit(category).alias("category"), text.alias("text"), mandatory.alias("mandatory"), number.alias("value_num"), string.alias("value_str"))

        return F.transform(F.regexp_extract_all("said", F.lit(pattern), F.lit(0)), item).cast(ITEMS)

    rows = rows.withColumn("stated", F.concat(*[structured(rank, category, *family) for rank, (category, family) in enumerate(FAMILIES.items())]))
    rows = rows.withColumn("known", F.filter(F.transform("stated", lambda x: x["text"]), lambda s: s.isNotNull()))
    pieces = F.transform(F.split("said", r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    obliging = F.filter(F.transform(pieces, lambda s, i: F.struct(i.alias("pos"), s.alias("s"))), lambda x: F.length(x["s"]).between(25, 700) & x["s"].rlike(OBLIGATION))
    room = F.greatest(F.lit(most) - F.size("known"), F.lit(1))

    def taken(acc: Column, x: Column) -> Column:
        told = F.exists(F.concat(F.col("known"), F.transform(acc, lambda y: y["s"])), lambda k: x["s"].contains(k) | k.contains(x["s"]))
        return F.when((F.size(acc) >= room) | told, acc).otherwise(F.concat(acc, F.array(x)))

    def free(x: Column) -> Column:
        kind = F.coalesce(*[F.when(x["s"].rlike(p), k) for k, p in SENTENCE_KINDS.items()], F.lit("technical"))
        return F.struct(F.lit(len(FAMILIES)).alias("family"), x["pos"].alias("pos"), kind.alias("category"), x["s"].alias("text"), F.lit(True).alias("mandatory"), none.cast("double").alias("value_num"), none.cast("string").alias("value_str"))

    rows = rows.withColumn("pieces", obliging).withColumn("free", F.aggregate("pieces", F.array().cast("array<struct<pos:int,s:string>>"), taken))
    items = F.concat("stated", F.coalesce(F.transform("free", free).cast(ITEMS), no_item)).alias("items")
    excerpt = F.when(F.col("said").rlike(INJECTION), F.regexp_extract("said", INJECTION, 0)).alias("excerpt")
    # a lot's requirements stay together, as one row, until they are numbered: texts are read once and shuffled once
    before = Window.partitionBy("notice_id").orderBy("lot_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("notice_id", "lot_id", "notice_url", excerpt, items).withColumn("before", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)))
    rows = stage(rows, "lot-requirements")

    each = rows.select("notice_id", "lot_id", "notice_url", "before", F.posexplode("items").alias("place", "x")).select("notice_id", "lot_id", "notice_url", (F.col("before") + F.col("place") + 1).alias("n"), "x.*")
    structured_value = F.col("value_num").isNotNull() | F.col("value_str").isNotNull()
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    evidence_id = F.concat(F.lit(f"{source}:"), "notice_id", F.lit(":"), "lot_id", F.lit(":requirement-"), "n").alias("evidence_id")
    requirements = each.select(
        F.concat_ws(":", "notice_id", F.lit("req"), "n").alias("requirement_id"), "notice_id", "lot_id", "category", "text", F.lit("eligibility").alias("requirement_type"), "mandatory",
        F.when(F.col("value_num").isNotNull(), ">=").when(F.col("value_str").isNotNull(), "contains").alias("operator"), "value_num", "value_str", F.when(F.col("value_num").isNotNull(), units[F.col("category")]).alias("unit"),
        F.lit("UNKNOWN").alias("stage"), F.lit("description-lot").alias("source_field"), evidence_id,
        F.when(F.col("family") == len(FAMILIES), 0.7).otherwise(0.92).alias("confidence"), F.when(structured_value, "STRUCTURED").otherwise("UNSTRUCTURED").alias("extraction_status"),
    )
    by_lot = F.row_number().over(Window.partitionBy("notice_id").orderBy("lot_id"))
    found = rows.filter("excerpt is not null").select("notice_id", "lot_id", "notice_url", "excerpt").withColumn("n", by_lot).withColumn("evidence_id", F.concat(F.lit(f"{source}:"), "notice_id", F.lit(":"), "lot_id", F.lit(":security-"), "n"))
    findings = found.select(F.concat_ws(":", "notice_id", F.lit("security"), "n").alias("finding_id"), "notice_id", "lot_id", F.lit("PROMPT_INJECTION").alias("type"), F.lit("HIGH").alias("severity"), "excerpt", "evidence_id")
    evidence = each.select(evidence_id, "notice_id", "lot_id", F.lit("requirement").alias("field"), F.substring("text", 1, 1000).alias("excerpt"), F.col("notice_url").alias("source_url"))
    evidence = evidence.unionByName(found.select("evidence_id", "notice_id", "lot_id", F.lit("security_finding").alias("field"), "excerpt", F.col("notice_url").alias("source_url")))
    return requirements, findings, evidence.withColumn("source", F.lit(source.upper()))


#: Kinds of procedure that a search may ask for (fixed values).
PROCEDURES = ("open", "restricted", "neg-w-call", "comp-dial", "innovation", "neg-wo-call", "other")


def _country(value: str) -> str:
    code = re.sub("[^A-Z]", "", value.upper())
    if len(code) != 3:
        raise ValueError(f"not a three-letter country: {value}")
    return code


def notice_search(filters: dict, as_of: str, days: int = 90) -> Column:
    """Predicate over notices (title, description, cpv_codes, buyer_country, place_countries, published, procedure_type).

    filters may have keywords (a phrase), cpv (digits, a * at the end stands for any more), buyer_country, place_country,
    published_from, published_to and procedure_type. Without dates the last `days` before as_of count.
    """
    start = filters.get("published_from") or str(date.fromisoformat(as_of) - timedelta(days=days))
    stop = filters.get("published_to") or as_of
    if date.fromisoformat(start) > date.fromisoformat(stop):
        raise ValueError("published_from is after published_to")
    out = F.col("published").between(F.lit(start).cast("date"), F.lit(stop).cast("date"))
    if phrase := str(filters.get("keywords") or "").replace('"', "")[:120]:
        out &= F.lower(F.concat_ws(" ", "title", "description")).contains(phrase.lower())
    if filters.get("cpv"):
        code = re.sub(r"[^0-9*]", "", str(filters["cpv"]))[:9]
        if not re.fullmatch(r"[0-9]+\**", code):
            raise ValueError(f"not a code: {filters['cpv']}")
        digits = code.rstrip("*")
        out &= F.exists("cpv_codes", lambda c: c.startswith(digits) if "*" in code else c == digits)
    if filters.get("buyer_country"):
        out &= F.col("buyer_country") == _country(filters["buyer_country"])
    if filters.get("place_country"):
        out &= F.array_contains("place_countries", _country(filters["place_country"]))
    if procedure := filters.get("procedure_type"):
        if procedure not in PROCEDURES:
            raise ValueError(f"not a procedure: {procedure}")
        out &= F.col("procedure_type") == procedure
    return F.coalesce(out, F.lit(False))


def check_outcome() -> Column:
    """PASS, FAIL, UNKNOWN or NOT_APPLICABLE of a requirement joined to a profile."""
    accepted = F.transform(F.coalesce("value_list", F.array("value_str")), F.lower)
    codes = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    supplied = F.flatten(F.transform("languages", lambda x: F.array(F.lower(x), F.coalesce(F.try_element_at(codes, F.lower(x)), F.lower(x)))))
    yes = lambda c: F.when(c, "PASS").otherwise("FAIL")
    return (
        F.when(F.col("stage") == "NOT_REQUIRED", "NOT_APPLICABLE")
        .when((F.col("category") == "turnover") & F.col("value_num").isNotNull(), F.when(F.col("annual_turnover").isNull(), "UNKNOWN").otherwise(yes(F.col("annual_turnover") >= F.col("value_num"))))
        .when((F.col("category") == "references") & F.col("value_num").isNotNull(), yes(F.col("reference_count") >= F.col("value_num")))
        .when((F.col("category") == "certification") & F.col("value_str").isNotNull(), yes(F.array_contains(F.transform("certifications", F.lower), F.lower("value_str"))))
        .when((F.col("category") == "language") & (F.col("value_str").isNotNull() | F.col("value_list").isNotNull()), yes(F.arrays_overlap(accepted, supplied)))
        .otherwise("UNKNOWN")
    )


def fit_score(as_of: str) -> Column:
    """0 to 100 from capability, geography, value range and deadline of a lot joined to a profile."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    terms = F.create_map(*[x for k, v in CAPABILITY_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    shown = F.filter("capabilities", lambda c: F.exists(F.coalesce(F.try_element_at(terms, F.lower(c)), F.array(F.lower(c))), lambda w: F.contains(text, w)))
    in_range = F.col("value").isNotNull() & (F.col("value") >= F.coalesce("min_contract_value", F.lit(0.0))) & (F.col("value") <= F.coalesce("max_contract_value", F.lit(float("inf"))))
    is_open = F.coalesce(F.substring("deadline", 1, 10) >= F.lit(as_of), F.lit(False))
    points = lambda c, n: F.when(c, n).otherwise(0)
    return F.least(F.lit(50), F.size(shown) * 10) + points(F.coalesce(F.arrays_overlap("place_of_performance", "countries_served"), F.lit(False)), 20) + points(in_range, 20) + points(is_open, 10)


def assess(lots: DataFrame, requirements: DataFrame, profiles: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checks, lots, notices) of every lot and supplier profile.

    A requirement without a lot holds for all lots of its notice: two equi-joins, not one on an OR. Profiles are a
    table of some rows, crossed with lots. Outcomes are added up per lot, and per notice, before they meet the lots.
    """
    few, keys = bounded(profiles), lots.select("notice_id", "lot_id")
    of_lot, of_notice = requirements.filter("lot_id is not null"), requirements.filter("lot_id is null").drop("lot_id")
    each = of_lot.join(keys, ["notice_id", "lot_id"]).unionByName(of_notice.join(keys, "notice_id"), allowMissingColumns=True).crossJoin(few)
    mandatory = F.coalesce("mandatory", F.lit(False)).alias("mandatory")
    checks = each.select("profile_id", "notice_id", "lot_id", "requirement_id", "category", mandatory, check_outcome().alias("outcome"))
    must = F.col("mandatory")

    def sums(part: DataFrame, *by: str) -> DataFrame:
        rows = part.crossJoin(few).select("profile_id", *by, mandatory, check_outcome().alias("outcome"))
        return rows.groupBy("profile_id", *by).agg(*[F.bool_or(must & c).alias(f"{k}_{len(by)}") for k, c in {"blocked": F.col("outcome") == "FAIL", "unsure": F.col("outcome") == "UNKNOWN", "tested": F.col("outcome") != "NOT_APPLICABLE"}.items()])

    scored = lots.crossJoin(few).select("profile_id", "notice_id", "lot_id", fit_score(as_of).alias("fit"))
    scored = scored.join(sums(of_lot, "notice_id", "lot_id"), ["profile_id", "notice_id", "lot_id"], "left").join(bounded(sums(of_notice, "notice_id")), ["profile_id", "notice_id"], "left")
    either = lambda k: F.coalesce(f"{k}_2", F.lit(False)) | F.coalesce(f"{k}_1", F.lit(False))
    scored = scored.withColumns({k: either(k) for k in ("blocked", "unsure", "tested")})
    status = F.when(F.col("blocked"), "NO_BID").when(~F.col("tested"), "INSUFFICIENT_EVIDENCE").when(F.col("unsure"), "REVIEW").otherwise("BID")
    level = lambda c: F.when(c >= 70, "HIGH").when(c >= 40, "MEDIUM").otherwise("LOW")
    by_lot = scored.select("profile_id", "notice_id", "lot_id", status.alias("status"), "fit", level(F.col("fit")).alias("fit_label"))
    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("lot_id"))))
    rolled = by_lot.groupBy("profile_id", "notice_id").agg(listed("BID").alias("eligible_lots"), listed("REVIEW").alias("review_lots"), listed("INSUFFICIENT_EVIDENCE").alias("no_evidence_lots"), listed("NO_BID").alias("blocked_lots"), F.max("fit").alias("fit"))
    decision = F.when(F.size("eligible_lots") > 0, "BID").when(F.size("review_lots") > 0, "REVIEW").when(F.size("no_evidence_lots") > 0, "INSUFFICIENT_EVIDENCE").otherwise("NO_BID")
    return checks, by_lot, rolled.withColumn("status", decision).withColumn("fit_label", level(F.col("fit")))


def ingest(batch: DataFrame, state: DataFrame, key: str, fields: list[str], order: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(new state, rows to append to the version history) from a batch of rows with `fields`.

    state has the key, fields, fingerprint, version, first_seen and last_seen. Of several rows of a key in one batch
    the newest by `order` wins. An unchanged fingerprint only refreshes last_seen.
    """
    new = latest_per_key(batch, [key], [order]).withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256))
    stamp = F.lit(now).cast("timestamp")
    old = state.select(key, F.col("fingerprint").alias("__f"), F.col("version").alias("__v"), F.col("first_seen").alias("__s"))
    rows = new.join(old, key, "left").withColumn("status", F.when(F.col("__f").isNull(), "new").when(F.col("__f") != F.col("fingerprint"), "updated").otherwise("unchanged"))
    rows = rows.withColumns({"version": F.coalesce("__v", F.lit(0)) + (F.col("status") != "unchanged").cast("int"), "first_seen": F.coalesce("__s", stamp), "last_seen": stamp})
    columns = [key, *fields, "fingerprint", "version", "first_seen", "last_seen"]
    kept = state.select(*columns).join(new.select(key), key, "left_anti")
    return kept.unionByName(rows.select(*columns)), rows.filter("status <> 'unchanged'").select(*columns, "status")


def compare_versions(history: DataFrame, key: str, fields: list[str], a: int, b: int, material: set[str]) -> DataFrame:
    """Changed fields from version a to version b of each key that has both."""
    return field_diff(history.filter(F.col("version") == a), history.filter(F.col("version") == b), [key], fields, material)
