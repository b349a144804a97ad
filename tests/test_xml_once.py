"""A document is parsed once, as a tree, so what looks like an element in a comment or a value is none."""

from millrace.operators import eforms
from millrace.plans import registered

ODD = [
    ("comment", '<a><!-- <x:ProcurementProjectLot><ID>LOT-7</ID></x:ProcurementProjectLot> --><x:ProcurementProjectLot><ID>LOT-1</ID><Note>a<!-- b -->c</Note></x:ProcurementProjectLot></a>', [("LOT-1", ["ac"], [], [])]),
    ("value", '<a><ProcurementProjectLot name="x>y"><ID n="a>b">LOT-1</ID><Description><![CDATA[</ProcurementProjectLot> & <ID>]]></Description></ProcurementProjectLot></a>', [("LOT-1", ["</ProcurementProjectLot> & <ID>"], [], [])]),
    ("undeclared", '<q:a xsi:x="1"><q:ProcurementProjectLot><q:ID>no</q:ID><q:ID> LOT-2 </q:ID><q:Note> a \n b </q:Note><q:Description>a b</q:Description><q:Note/></q:ProcurementProjectLot><ProcurementProjectLot/></q:a>', [("LOT-2", ["a b"], [], [])]),
    (
        "nested",
        '<?xml version="1.0" encoding="ISO-8859-1"?><a><b><ProcurementProjectLot><ID>LOT-1</ID><c><SelectionCriteria><TendererRequirementTypeCode listName="other">o</TendererRequirementTypeCode><TendererRequirementTypeCode listName="selection-criterion"> k </TendererRequirementTypeCode></SelectionCriteria></c>'
        "<SelectionCriteria><Description>é <i>in</i></Description></SelectionCriteria><SelectionCriteria/><SubordinateAwardingCriterion><ParameterNumeric>1</ParameterNumeric></SubordinateAwardingCriterion><SubordinateAwardingCriterion><ParameterNumeric>1 0,5</ParameterNumeric><Description> d</Description></SubordinateAwardingCriterion></ProcurementProjectLot></b></a>",
        [("LOT-1", ["é", "in", "d"], [("k", "k"), ("selection-criterion", "é")], [("Award criterion", "other", 10.5, None, "d")])],
    ),
    ("none", "<a/>", []),
]


def test_odd_documents(spark):
    documents = spark.createDataFrame([r[:2] for r in ODD] + [("dtd", "<!DOCTYPE a [<!ENTITY x 'y'>]><a/>"), ("open", "<a><b></a>"), ("empty", ""), ("null", None), ("name", "<a>&nbsp;</a>")], "notice_id string, xml string")
    lots, rejected = eforms.read_lots(documents)
    got = {}
    for r in lots.collect():
        got.setdefault(r.notice_id, []).append((r.lot_id, r.texts, [tuple(x) for x in r.selections], [tuple(x) for x in r.awards]))
    assert got == {name: found for name, _, found in ODD if found}
    assert {tuple(r) for r in rejected.collect()} == {("dtd", "UNSAFE_XML"), ("open", "INVALID_XML"), ("empty", "INVALID_XML"), ("null", "NO_XML"), ("name", "INVALID_XML")}


def test_documents_are_parsed_once(spark):
    plan = eforms.read_lots(spark.createDataFrame([r[:2] for r in ODD], "notice_id string, xml string"))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "xpath" not in plan and "from_xml" not in plan


def test_lots_are_not_broadcast(spark, sf):
    plan = registered().QUERIES["xml_lot_enrichment"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
