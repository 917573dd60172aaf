import pytest
from pyspark.sql import functions as F

from kinweave.functions import conditions, standardize, values


def column(spark, function, given):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


CASES = {
    standardize.normalize_name: {"  j.  smith, jr ": "J SMITH JR", "...": "", "王小明": "王小明", "": None, None: None, "a b": "A B"},
    standardize.normalize_date: {" 1985-06-15\t": "1985-06-15", "31/02/x": "31/02/x", "": None},
    standardize.normalize_email: {" A@B.com ": "a@b.com", "a@b": None, "noat": None, "a@b@c.d": None, "a@b.c@d": "a@b.c@d"},
    standardize.normalize_phone: {"+852-9123-4567": "+85291234567", "85291234567": "+85291234567", "91234567": "+85291234567", "12345": "+12345", "abc": None, "+12345678": "+12345678"},
    standardize.normalize_gov_id: {"K9876543": "K987654(3)", "k987654(3)": "K987654(3)", "PA12345678": "PA12345678", " x1 ": "X1"},
    standardize.normalize_address: {" 1  Main\n st., ": "1 MAIN ST.,"},
    standardize.normalize_gender: {" male": "M", "Woman": "F", "non-binary": "O", "x": "X", "": None},
    standardize.normalize_default: {" aB ": "AB"},
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_normalizers(spark, function):
    assert column(spark, function, list(CASES[function])) == list(CASES[function].values())


def test_classifiers(spark):
    of = lambda f, vs: [(r["subtype"], r["confidence"]) for r in column(spark, f, vs)]
    assert of(standardize.classify_gov_id, ["A123456(7)", "AB123456(7)", "PA12345678", "A123456789", "Z"]) == [("HKID", 1.0), ("HKID", 1.0), ("PASSPORT", 0.9), ("DRIVERS_LICENSE", 0.7), ("GOV_ID_UNKNOWN", 0.5)]
    assert of(standardize.classify_phone, ["+85291234567", "+85221234567", "+4915112345678", "+123"]) == [("MOBILE", 0.95), ("LANDLINE", 0.95), ("MOBILE", 0.7), ("PHONE_GENERIC", 0.5)]
    assert of(standardize.classify_email, ["a@gmail.com", "a@b.com"]) == [("EMAIL_PERSONAL", 0.9), ("EMAIL_GENERIC", 0.8)]
    rows = spark.createDataFrame([("Email Address", " A@B.C "), ("Gender", "man"), ("Nickname", " x ")], "n string, v string")
    assert [r[0] for r in rows.select(standardize.normalize(F.col("n"), F.col("v"))).collect()] == ["a@b.c", "M", "X"]


def test_conditions(spark):
    rows = spark.createDataFrame([("Primary", 1, "ABCDEFGH"), ("Spouse", 2, "A"), (None, 3, None), ("Child", 4, "=x")], "kind string, n int, code string")
    ask = lambda text: [r[0] for r in rows.orderBy("n").select(conditions.compile_condition(text, rows.columns)).collect()]
    assert ask("kind='Primary'") == [True, False, False, False]
    assert ask("kind IN ('Spouse', \"Child\")") == [False, True, False, True]
    assert ask("n='3'") == [False, False, True, False]
    assert ask("code='=x'") == [False, False, False, True]
    assert ask("LEN(code)==8") == [True, False, False, False]
    assert ask("missing='a'") == [False] * 4
    with pytest.raises(ValueError):
        conditions.compile_condition("kind > 3")
    rules = [("kind='Primary'", "a"), ("kind IN ('Spouse','Child','Primary')", "b")]
    assert [r[0] for r in rows.orderBy("n").select(conditions.first_match(rules, otherwise=F.lit("?"))).collect()] == ["a", "b", "?", "b"]
    with pytest.raises(Exception, match="no party type condition"):
        rows.select(conditions.first_match(rules)).collect()
    assert [r[0] for r in rows.orderBy("n").select(conditions.any_present(["kind", "code"])).collect()] == [True, True, False, True]


def test_ids_and_labels(spark):
    assert column(spark, values.next_version, ["id", "id_v2", "id_v19", "a_vb", "x_v2_y"]) == ["id_v2", "id_v3", "id_v20", "a_vb_v2", "x_v2_y_v2"]
    assert column(spark, values.role_of, ["a.b.c", "x"]) == ["c", "x"]
    assert column(spark, values.table_prefix, ["SP_Sales_lead_L1"]) == ["lead"]
    assert column(spark, values.reason_code, ["different_hkid_blocks_match"]) == ["DIFFERENT_HKID"]
    assert column(spark, values.attribute_label, ["ATTR_FIRST_NAME"]) == ["FIRST NAME"]
    assert column(spark, values.parsed_json, ['{"a": 1, "b": "x"}', "oops", None]) == [{"a": "1", "b": "x"}, {"raw": "oops"}, {}]
    assert column(spark, values.json_list, ['["a","b"]', "no"]) == [["a", "b"], None]
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(values.numbered("ENTITY_", F.lit(7))) == "ENTITY_0007" and get(values.numbered("ENTITY_", F.lit(123456))) == "ENTITY_123456"
    assert get(values.percent(F.lit(0.286))) == "29%"
    assert get(values.party_id("S", "t", F.lit(3), F.lit("r"))) == "SP_S_t_3_r"
    assert get(values.ratio(F.lit(0), F.lit(0))) == 0.0 and get(values.ratio(F.lit(1), F.lit(3))) == 0.25
    assert get(values.stable_id(F.lit("a"), F.lit(None))) != get(values.stable_id(F.lit("a"), F.lit("")))
    assert get(values.reason_label(F.lit("SOME_CODE"))) == "Some Code"
    assert get(values.reason_text(F.lit("GENDER_CONFLICT"), F.expr("map('b', '2', 'a', '1')"))) == "Same name, different gender (a=1, b=2)"
    assert [get(values.edge_band(F.lit(x))) for x in (49, 50, 70, 90)] == ["poor", "fair", "good", "strong"]
    assert [get(values.score_band(F.lit(x))) for x in (0.9, 0.7, 0.1)] == ["high", "medium", "low"]
    assert [get(values.evidence_band(F.lit(x))) for x in (0.95, 0.85, 0.75, 0.1)] == ["very high", "high", "medium", "low"]
    assert [get(values.match_band(F.lit(x))) for x in (100, 50, 49)] == ["full", "partial", "poor"]
