"""Retrieval, claims, decisions and patterns over documents, benchmark, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import eforms, grounding, retrieval, tenders
from millrace.plans.registry import Tables, query
from millrace.sources.shared import shuffled, stage

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9+#.]{2,}')"
_BM25 = f"""d AS (SELECT doc_id AS doc, {_TOK} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgl FROM d), p AS (SELECT doc, token, len AS length, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS token FROM d) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id AS query, unnest(list_distinct({_TOK})[1:12]) AS token FROM (SELECT item_id, text FROM benchmark)), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT query, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl))), 6) AS score FROM p JOIN q USING (token) JOIN df USING (token), st GROUP BY ALL)"""


@query(f"SELECT doc_id, cast(len({_TOK}) AS INTEGER) AS n, array_to_string({_TOK}, ' ') AS tokens FROM documents")
def tokenize(t: Tables) -> DataFrame:
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z0-9+#.]{2,}"), F.lit(0))
    return t.documents.select("doc_id", F.size(found).alias("n"), F.array_join(found, " ").alias("tokens"))


def _bm25(t: Tables, asked: DataFrame, k: int) -> DataFrame:
    """Statistics cover all documents."""
    tokens = retrieval.tokenized(t.documents, "doc_id", "text")
    return retrieval.bm25(asked, stage(retrieval.postings(tokens, asked), "postings"), *retrieval.statistics(tokens), k)


def _asked(df: DataFrame, key: str) -> DataFrame:
    """The first 12 distinct tokens of each text."""
    return stage(df.select(F.col(key).alias("query"), F.explode(F.slice(F.array_distinct(retrieval.tokens_of("text")), 1, 12)).alias("token")), "asked")


def _first_distinct(sql: str) -> str:
    """DuckDB's list_distinct loses the order; the first twelve distinct tokens need their first places."""
    q = f"q AS (SELECT query, token FROM (SELECT item_id AS query, token, min(i) AS i FROM (SELECT item_id, unnest({_TOK}) AS token, generate_subscripts({_TOK}, 1) AS i FROM benchmark) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY i) <= 12)"
    return sql.replace(sql[sql.index("q AS (SELECT DISTINCT") : sql.index(", df AS")], q)


_LEXICAL = _first_distinct(_BM25)


@query(f"WITH {_LEXICAL} SELECT query, doc, score, cast(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS place FROM s QUALIFY place <= 50")
def bm25_topk(t: Tables) -> DataFrame:
    """Queries are the benchmark items."""
    return _bm25(t, _asked(t.benchmark, "item_id"), 50)


_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v), qs AS (SELECT vec_id AS query, e AS qe, n AS qn FROM u WHERE vec_id % 50 = 0), vs AS (SELECT query, vec_id AS doc, round(greatest(list_dot_product(list_transform(qe, lambda x: x / qn), list_transform(e, lambda x: x / n)), 0), 6) AS score FROM u, qs WHERE vec_id <> query)"


def _queries(t: Tables) -> DataFrame:
    """The stated query set: every id divisible by 50, against all rows."""
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


def _docs(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


@query(f"WITH {_VEC} SELECT query, doc, score, cast(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS place FROM vs QUALIFY place <= 10")
def vector_topk(t: Tables) -> DataFrame:
    return retrieval.vector_topk(_queries(t), _docs(t), 10)


@query("SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t: Tables) -> DataFrame:
    """Each vector against that of the next id."""
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.select("vec_id", "embedding").join(b, "vec_id").select("vec_id", F.round(C.cosine("embedding", "b"), 5).alias("cosine"))


def _own_tokens(t: Tables) -> DataFrame:
    """Lexical queries are the tokens of the documents whose ids are queries."""
    ids = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("doc_id"))
    return _asked(t.documents.join(ids, "doc_id", "left_semi"), "doc_id")


def _lexical(t: Tables) -> DataFrame:
    return stage(_bm25(t, _own_tokens(t), 50), "lexical")


def _hybrid_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents and vectors meet by id."""
    return stage(retrieval.vector_topk(_queries(t), _docs(t), 50), "vectors"), _lexical(t)


_OWN = _LEXICAL.replace("SELECT item_id, unnest", "SELECT doc_id AS item_id, unnest").replace("FROM benchmark)", "FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))")


@query(
    f"""WITH {_OWN}, {_VEC}, lex AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM s QUALIFY place <= 50), ok AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND source LIKE 'src1%' AND n_chars >= 500),
    h AS (SELECT query, doc, round(vs.score * 0.7 + coalesce(1 / place, 0) * 0.3, 6) AS score FROM vs JOIN ok ON doc = doc_id LEFT JOIN lex USING (query, doc)) SELECT query, doc, score, cast(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS place FROM h QUALIFY place <= 10"""
)
def hybrid_filtered(t: Tables) -> DataFrame:
    """Hybrid search among documents of some languages, with a prefix of their source and at least 500 characters."""
    docs = _docs(t).join(t.documents.select(F.col("doc_id").alias("doc"), "lang", "source", "n_chars"), "doc")
    where = F.col("lang").isin("en", "es") & F.col("source").startswith("src1") & (F.col("n_chars") >= 500)
    return retrieval.hybrid_search(_queries(t), docs, _lexical(t), (0.7, 0.3), 10, where)


@query(f"WITH {_VEC} SELECT query, doc, score, cast(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS place FROM vs JOIN embeddings ON doc = vec_id WHERE label < 5 QUALIFY place <= 5")
def similar_items(t: Tables) -> DataFrame:
    """The five items of some labels next to each item of the query set, by its own vector."""
    docs = t.embeddings.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label")
    return retrieval.similar_items(docs, docs.filter("doc % 50 = 0"), 5, F.col("label") < 5)


@query(
    f"""WITH {_OWN}, {_VEC}, lex AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM s QUALIFY place <= 50), vec AS (SELECT query, doc, score FROM vs QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 50),
    h AS (SELECT query, doc, round(coalesce(score, 0) * 0.7 + coalesce(1 / place, 0) * 0.3, 6) AS score FROM vec FULL JOIN lex USING (query, doc)) SELECT query, doc, score, cast(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS place FROM h QUALIFY place <= 10"""
)
def hybrid_topk(t: Tables) -> DataFrame:
    vector, lexical = _hybrid_parts(t)
    return retrieval.hybrid(vector, lexical, (0.7, 0.3), 10)


@query()
def weight_ablation(t: Tables) -> DataFrame:
    """Ranking quality of five weight pairs over all vectors and all lexical hits; vectors of the query's label are relevant, its own too."""
    asked = _own_tokens(t)
    tokens = retrieval.tokenized(t.documents, "doc_id", "text")
    w = retrieval.impacts(asked, stage(retrieval.postings(tokens, asked), "postings"), *retrieval.statistics(tokens))
    labels = t.embeddings.select(F.col("vec_id").alias("doc"), "label")
    return retrieval.weight_ablation(_queries(t), _docs(t), labels, asked, w, [(1.0, 0.0), (0.75, 0.25), (0.5, 0.5), (0.25, 0.75), (0.0, 1.0)])


@query(f"WITH {_VEC}, r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM vs QUALIFY place <= 10), j AS (SELECT a.vec_id AS query, b.vec_id AS doc FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), p AS (SELECT query, count(*) AS rel, min(place) AS best, count(*) FILTER (WHERE place <= 5) AS found, sum(ln(2) / ln(place + 1)) FILTER (WHERE place <= 5) AS dcg FROM j LEFT JOIN r USING (query, doc) GROUP BY 1) SELECT round(avg(coalesce(1 / best, 0)), 6) AS mrr, round(avg(found / rel), 6) AS recall, round(avg(coalesce(dcg, 0) / list_sum([ln(2) / ln(i + 1) for i in range(1, least(rel, 5) + 1)])), 6) AS ndcg FROM p")
def retrieval_metrics(t: Tables) -> DataFrame:
    labels = t.embeddings.select("vec_id", "label")
    judged = labels.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query").join(labels.withColumnRenamed("vec_id", "doc"), "label").filter("query <> doc").select("query", "doc")
    return retrieval.retrieval_metrics(stage(retrieval.vector_topk(_queries(t), _docs(t), 10), "vectors"), judged)


def _claims(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each conversation is an answer, its turns are claims that cite a benchmark item, or every third time one that does
    not exist; every other third claim quotes the item that it cites."""
    evidence = t.benchmark.select(F.col("item_id").cast("string").alias("evidence_id"), "text", F.lit(False).alias("is_decision"))
    items = F.broadcast(t.benchmark.agg(F.count(F.lit(1)).alias("items")))
    turns = t.conversations.crossJoin(items).withColumn("cited", F.when(F.col("turn") % 3 == 2, "none").otherwise((F.col("conv_id") % F.col("items")).cast("string")))
    quoted = turns.join(evidence.select(F.col("evidence_id").alias("cited"), F.substring("text", 1, 80).alias("quote")), "cited", "left")
    claim = F.struct("turn", F.when(F.col("turn") % 3 == 1, F.coalesce("quote", "text")).otherwise(F.col("text")).alias("text"), F.array("cited").alias("evidence_ids"))
    answers = quoted.groupBy(F.col("conv_id").alias("answer_id")).agg(F.transform(F.array_sort(F.collect_list(claim)), lambda x: F.struct(x["text"].alias("text"), x["evidence_ids"].alias("evidence_ids"))).alias("claims"))
    return answers, evidence


_STOP = "[" + ", ".join(f"'{w}'" for w in grounding.STOPWORDS) + "]"
_NUM = r"list_distinct(list_transform(regexp_extract_all(lower({x}), '(?:^|[^a-z])(\d+(?:[.,]\d+)?)', 1), lambda x: replace(x, ',', '.')))"
_CL = rf"""c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN 'none' ELSE cast(conv_id % (SELECT count(*) FROM benchmark) AS VARCHAR) END AS eid FROM conversations), e AS (SELECT cast(item_id AS VARCHAR) AS eid, text AS etext FROM benchmark),
    d AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN coalesce(substr(etext, 1, 80), text) ELSE text END AS text, etext FROM c LEFT JOIN e USING (eid)),
    k AS (SELECT conv_id, turn, text, etext, list_filter(list_distinct({_TOK}), lambda w: NOT list_contains({_STOP}, w)) AS a, list_filter(list_distinct({_TOK.replace("text", "etext")}), lambda w: NOT list_contains({_STOP}, w)) AS b,
    {_NUM.format(x="text")} AS na, {_NUM.format(x="coalesce(etext, '')")} AS nb FROM d),
    v AS (SELECT *, etext IS NOT NULL AND len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.5 AND list_has_all(nb, na) AND NOT regexp_matches(text, '(?i)ignore all previous|system prompt|fake:\d+|<untrusted') AND NOT regexp_matches(upper(text), '\b(?:BID|NO_BID|REVIEW|INSUFFICIENT_EVIDENCE)\b') AS ok FROM k)"""


@query(f"WITH {_CL} SELECT conv_id AS answer_id, count(*) AS claims, count(*) FILTER (WHERE ok) AS supported, count(*) AS cited, count(etext) AS known, round(count(*) FILTER (WHERE ok) / count(*), 6) AS support_rate, round(count(etext) / count(*), 6) AS citation_validity, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN 'ANSWERED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM v GROUP BY 1")
def claim_verification(t: Tables) -> DataFrame:
    answers, evidence = _claims(t)
    return grounding.verify_claims(answers, evidence)[1].drop("answer")


@query(f"WITH {_CL} SELECT conv_id AS answer_id, turn, ok AS supported, etext IS NOT NULL AS known FROM v")
def claim_evidence(t: Tables) -> DataFrame:
    answers, evidence = _claims(t)
    return grounding.verify_claims(answers, evidence)[0].select("answer_id", F.col("pos").cast("long").alias("turn"), "supported", (F.col("n_known") > 0).alias("known"))


_PATTERNS = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "secret": r"token = .[0-9a-f]{20,}", "phone": r"\+\d+ \(\d{3}\) \d{3}-\d{4}"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS finding, regexp_extract(text, '{p}') AS excerpt FROM documents WHERE regexp_matches(text, '{p}')" for k, p in _PATTERNS.items()))
def quarantine_patterns(t: Tables) -> DataFrame:
    """The first match of each pattern goes to a side table; the text stays."""
    hits = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("finding"), F.regexp_extract("text", p, 0).alias("excerpt"))) for k, p in _PATTERNS.items()])
    return t.documents.select("doc_id", F.inline(F.filter(hits, lambda x: x.isNotNull())))


#: Orders as notices: each line is a lot that asks for what the line says. A line number may occur twice in an order.
_LOT = """lots AS (SELECT cast(l_orderkey AS VARCHAR) AS notice_id, 'LOT-' || l_linenumber AS lot_id, l_linenumber AS line, floor(min(l_extendedprice)) AS turnover, floor(min(l_quantity)) AS refs, min(l_returnflag) = 'R' AS certified FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_extendedprice", "l_quantity", "l_returnflag")])


def _lots(t: Tables) -> DataFrame:
    whole = lambda c: F.floor(c).cast("long").cast("string")
    asked = F.concat(
        F.lit("Minimum annual turnover of "), whole("l_extendedprice"), F.lit(" EUR. At least "), whole("l_quantity"), F.lit(" references."),
        F.when(F.col("l_returnflag") == "R", " ISO 9001 is required.").otherwise(" Bidders must write English."),
        F.when(F.col("l_linenumber") % 2 == 0, " The supplier must employ qualified staff at all times.").otherwise(""),
    )
    return _lines(t).select(
        F.col("l_orderkey").cast("string").alias("notice_id"), F.concat(F.lit("LOT-"), F.col("l_linenumber").cast("string")).alias("lot_id"), F.lit("Data platform").alias("title"), asked.alias("description"),
        F.col("l_extendedprice").cast("double").alias("value"), F.lit("2026-12-31").alias("deadline"), F.array(F.lit("FIN")).alias("place_of_performance"),
    )


_PROFILE = "profile_id string, countries_served array<string>, capabilities array<string>, certifications array<string>, languages array<string>, annual_turnover double, reference_count int, min_contract_value double, max_contract_value double"


@query(
    f"""WITH {_LOT}, s AS (SELECT *, CASE WHEN turnover > 50000 OR refs > 25 OR certified THEN 'NO_BID' WHEN line % 2 = 0 THEN 'REVIEW' ELSE 'BID' END AS status FROM lots)
    SELECT notice_id, cast(count(*) FILTER (WHERE status = 'BID') AS INTEGER) AS eligible, cast(count(*) FILTER (WHERE status = 'REVIEW') AS INTEGER) AS review, cast(count(*) FILTER (WHERE status = 'NO_BID') AS INTEGER) AS blocked,
           CASE WHEN bool_or(status = 'BID') THEN 'BID' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'NO_BID' END AS decision FROM s GROUP BY 1"""
)
def decision_rollup(t: Tables) -> DataFrame:
    """Requirements of all lots, their checks against a profile, and the decision per notice."""
    lots = _lots(t)
    profile = t.spark.createDataFrame([("p", ["FIN"], ["SQL"], ["ISO 27001"], ["English"], 50_000.0, 25, None, None)], _PROFILE)
    asked = tenders.extract_requirements(lots)[0].withColumn("value_list", F.lit(None).cast("array<string>"))
    notices = tenders.assess(lots, asked, profile, "2026-06-01")[2]
    size = lambda c: F.size(c).cast("int")
    return notices.select("notice_id", size("eligible_lots").alias("eligible"), size("review_lots").alias("review"), size("blocked_lots").alias("blocked"), F.col("status").alias("decision"))


@query(
    f"""WITH {_LOT}, r AS (SELECT notice_id, lot_id, 'turnover' AS category, turnover AS v FROM lots UNION ALL SELECT notice_id, lot_id, 'references', refs FROM lots
      UNION ALL SELECT notice_id, lot_id, CASE WHEN certified THEN 'certification' ELSE 'language' END, NULL FROM lots UNION ALL SELECT notice_id, lot_id, 'staff', NULL FROM lots WHERE line % 2 = 0)
    SELECT category, CASE WHEN category IN ('turnover', 'references') THEN '>=' WHEN category <> 'staff' THEN 'contains' END AS operator, CASE WHEN category = 'staff' THEN 'UNSTRUCTURED' ELSE 'STRUCTURED' END AS state,
           count(*) AS n, count(*) AS with_evidence, cast(sum(v) AS DOUBLE) AS total FROM r GROUP BY 1, 2, 3"""
)
def extract_patterns(t: Tables) -> DataFrame:
    """Requirements that all lots state, each with its row of evidence."""
    asked, _, evidence = tenders.extract_requirements(_lots(t))
    rows = asked.join(shuffled(evidence.select("evidence_id", F.lit(True).alias("known"))), "evidence_id", "left")
    return rows.groupBy("category", "operator", F.col("extraction_status").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("with_evidence"), F.sum("value_num").alias("total"))


@query(
    f"""WITH {_LOT} SELECT CASE WHEN certified THEN 'turnover' ELSE 'staff' END AS kind, 'eforms:SelectionCriteria' AS field, count(*) AS n, cast(NULL AS DOUBLE) AS weight FROM lots GROUP BY 1
    UNION ALL SELECT 'technical', 'other', count(*), NULL FROM lots WHERE line = 1
    UNION ALL SELECT 'price', 'award', count(*), sum(refs + 0.5) FROM lots UNION ALL SELECT 'XML', 'procurement_document', count(*), NULL FROM lots"""
)
def xml_lot_enrichment(t: Tables) -> DataFrame:
    """Lots of all notices with what their XML says; of the requirements known before, those that the XML states go."""
    lines = _lines(t)
    lots = _lots(t).withColumns({"description": F.lit("Given."), "xml_url": F.lit("xml")})
    text = F.when(F.col("l_returnflag") == "R", "Financial &amp; other means").otherwise("Enough staff")
    lot = F.concat(
        F.lit("<cac:ProcurementProjectLot><cbc:ID>LOT-"), F.col("l_linenumber").cast("string"), F.lit('</cbc:ID><cac:SelectionCriteria><cbc:TendererRequirementTypeCode listName="selection-criterion">x</cbc:TendererRequirementTypeCode><cbc:Description>'), text,
        F.lit("</cbc:Description></cac:SelectionCriteria><cac:SubordinateAwardingCriterion><cbc:AwardingCriterionTypeCode>price</cbc:AwardingCriterionTypeCode><cbc:ParameterNumeric>"), F.floor("l_quantity").cast("long").cast("string"), F.lit(",5</cbc:ParameterNumeric></cac:SubordinateAwardingCriterion></cac:ProcurementProjectLot>"),
    )
    notice = F.col("l_orderkey").cast("string").alias("notice_id")
    documents = lines.groupBy(notice).agg(F.concat(F.lit('<Notice xmlns:cac="a" xmlns:cbc="b">'), F.array_join(F.collect_list(lot), ""), F.lit("</Notice>")).alias("xml"))
    known = lines.select(notice, F.concat(F.lit("LOT-"), F.col("l_linenumber").cast("string")).alias("lot_id"), F.when(F.col("l_returnflag") == "R", "Financial & other means").otherwise("Enough staff").alias("text"))
    known = known.unionByName(lines.filter("l_linenumber = 1").select(notice, F.lit("LOT-1").alias("lot_id"), F.lit("Another thing").alias("text"))).withColumns({"source_field": F.lit("other"), "category": F.lit("technical")})
    out = eforms.enrich(lots, known, documents)
    none = F.lit(None).cast("double")
    rows = out["requirements"].groupBy(F.col("category").alias("kind"), F.col("source_field").alias("field")).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", none)
    awards = out["awards"].groupBy(F.col("type").alias("kind"), F.lit("award").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    texts = out["evidence"].filter("field = 'procurement_document'").groupBy(F.lit("XML").alias("kind"), "field").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", none)
    return rows.unionByName(awards).unionByName(texts)
