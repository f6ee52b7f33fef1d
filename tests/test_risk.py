import pytest

from basketry.functions import defaults as D
from basketry.operators import risk as R

BASKETS = {
    1: ["甘草", "甘遂"], 2: ["乌头", "半夏"], 3: ["人参", "五灵脂"], 4: ["丁香", "郁金"], 5: ["甘草", "茯苓", "白术", "党参", "大枣", "生姜"],
    6: ["附子", "乌头"], 7: ["朱砂", "雄黄"], 8: ["附子", "川乌"], 9: ["雪上一枝蒿", "草乌", "甘草"], 10: ["附子", "甘草", "茯苓"], 11: ["水银", "轻粉"],
}


@pytest.fixture(scope="module")
def k(spark):
    return D.knowledge_tables(spark)


@pytest.fixture(scope="module")
def bi(spark):
    return spark.createDataFrame([(b, i) for b, xs in BASKETS.items() for i in xs], "basket_id int, item string")


@pytest.fixture(scope="module")
def found(bi, k):
    out = {}
    for r in R.detect_risk_pairs(bi, k["toxic"], k["pairs"], k["families"], k["reactions"], D.WORDS).collect():
        out.setdefault(r.basket_id, []).append(r)
    return out


def test_known_pairs_score(found):
    for b in (1, 2, 3, 4):
        assert max(r.risk_score for r in found[b]) >= 20
    assert 5 not in found
    assert found[1][0].risk_score == 75.0 and found[3][0].risk_score == 36.0


def test_overlap_and_inference(found):
    assert [r.priority for r in found[6]] == [2] and found[6][0].risk_score == 80.0
    assert [r.priority for r in found[7]] == [2]
    assert [(r.item_a, r.priority, r.risk_score) for r in found[9]] == [("草乌", 3, 55.0)]
    assert [(r.priority, r.risk_level) for r in found[11]] == [(3, "高")]
    assert len(found[8]) == 1


def test_assessment_and_overdose(spark, bi, k):
    doses = spark.createDataFrame([(10, "附子", 100.0)], "basket_id int, item string, dose double")
    rows = {r.basket_id: r for r in R.assess_risk(bi, k["toxic"], k["pairs"], k["families"], k["reactions"], doses, D.WORDS).collect()}
    assert set(rows) == set(BASKETS)
    assert rows[5].risk_level == "安全" and rows[5].risk_score == 0.0
    want = 0.3 * 0.0 + 0.3 / 3 + 0.12 * 0.12 + 0.15 * 0.15
    assert abs(rows[10].risk_score - want * 100) < 1e-9 and rows[10].n_overdose == 1
    over = R.overdose(doses, k["toxic"]).first()
    assert abs(over.percent_over - (100 / 15 - 1) * 100) < 1e-9


def test_pregnancy_and_profiles(spark, bi, k):
    p = {r.basket_id: r.overall_risk for r in R.pregnancy_risk(bi, k["toxic"], k["families"], D.WORDS).collect()}
    assert p[10] == "禁用" and p[5] == "安全" and p[11] == "忌用（推理）" and p[2] == "禁用"
    items = spark.createDataFrame([("水银",), ("附子",), ("茯苓",)], "item string")
    prof, reactions = R.expand_profiles(items, k["toxic"], k["families"], k["reactions"], k["type_rules"], D.WORDS)
    prof = {r.item: r for r in prof.collect()}
    assert prof["水银"].inferred_count == 3 and prof["水银"].pregnancy_risk == "禁用" and prof["水银"].confidence == 0.4
    assert prof["附子"].base_known and prof["茯苓"].pregnancy_risk == "未知"
    assert {r.type for r in reactions.filter("item = '附子' and inferred").collect()} == {"神经系统"}


def test_warnings_guidance_and_listing_use_the_vocabulary(spark, bi, k):
    found = R.detect_risk_pairs(bi, k["toxic"], k["pairs"], k["families"], k["reactions"], D.WORDS)
    assessed = R.assess_risk(bi, k["toxic"], k["pairs"], k["families"], k["reactions"], None, D.WORDS)
    over = R.overdose(spark.createDataFrame([(10, "附子", 100.0)], "basket_id int, item string, dose double"), k["toxic"])
    pregnant = R.pregnancy_items(bi, k["toxic"], k["families"], D.WORDS)
    rows = R.warnings(assessed, found, over, pregnant, D.WORDS).collect()
    assert {r.basket_id for r in rows if r.kind == "pair"} >= {1, 2} and any(r.kind == "overdose" for r in rows)
    risk = R.pregnancy_risk(bi, k["toxic"], k["families"], D.WORDS)
    texts = {"pregnancy": "not in pregnancy"}
    got = {r.basket_id: r.guidance for r in R.guidance(assessed, risk, texts, D.WORDS).collect()}
    assert got[5] == [] and got[10] == ["not in pregnancy"]
    edges = R.risk_edges(found)
    high = R.list_risk_pairs(edges, "高", words=D.WORDS).collect()
    assert high and {r.risk_level for r in high} <= {"高", "极高"}
    assert R.list_risk_pairs(edges, words=D.WORDS).count() >= len(high)
