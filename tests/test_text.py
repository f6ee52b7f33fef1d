import math

import pytest
from pyspark.sql import functions as F

from basketry.functions import defaults as D
from basketry.operators import profiles as P, review as V, text as X

TEXTS = ["一剂而愈，诸恙悉平", "药到病除，霍然而愈", "服药无效，病情加剧", "病情反复，迁延难愈", "稍安", "", "天气晴朗", "大效，不愈", "七日见效", "慢慢调理"]


def expected(text):
    """Straightforward sequential form of the rule, for checking."""
    taken, hits = set(), []
    for k, w, t in D.CASE_LEXICON.ordered():
        i = text.find(k)
        span = set(range(i, i + len(k)))
        if i < 0 or span & taken:
            continue
        taken |= span
        factor = 1.0
        if t == "pos":
            factor = next((m for p, m in D.INTENSIFIERS.items() if p + k in text), 1.0)
            if i > 0 and text[i - 1] in D.NEGATIONS:
                factor = -0.8
        hits.append((k, w * factor, t))
    return hits


@pytest.fixture(scope="module")
def evaluated(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    return {r.id: r for r in X.evaluate_texts(df, "text", D.CASE_LEXICON).collect()}


def test_hits_and_scores_follow_the_rule(evaluated):
    for i, text in enumerate(TEXTS):
        want = expected(text)
        got = [(h.keyword, round(h.weight, 9), h.type) for h in evaluated[i].matched_keywords]
        assert got == [(k, round(w, 9), t) for k, w, t in want], text
        s = max(-1, min(1, sum(w for _, w, _ in want) / max(len(want), 1) * 1.2)) if want else 0.0
        assert abs(evaluated[i].sentiment_score - s) < 1e-4


def test_signs_days_and_review(evaluated):
    assert evaluated[0].sentiment_score > 0.1 and evaluated[1].sentiment_score > 0.1
    assert evaluated[2].sentiment_score < 0 and evaluated[3].sentiment_score < 0
    assert evaluated[5].sentiment_score == 0 and evaluated[5].entropy == 1.0 and evaluated[5].overall_confidence == 0.0
    assert evaluated[0].days_to_effect == 1 and evaluated[8].days_to_effect == 7 and evaluated[9].days_to_effect is None
    assert evaluated[4].needs_human_review and not evaluated[0].needs_human_review
    assert evaluated[1].entropy == 0.0
    for r in evaluated.values():
        assert 0 <= r.score <= 100 and r.grade in range(5)
        if r.overall_confidence > 0:
            assert abs(sum(r.grade_probabilities) - 1) < 1e-3


def test_grades(spark):
    rows = [(0.9, 1.0), (0.5, 7.0), (0.0, None), (-0.8, 30.0), (0.3, None)]
    out = spark.createDataFrame(rows, "s double, d double").withColumn("g", X.ordinal_grade("s", "d")).collect()
    for (s, d), r in zip(rows, out):
        b = s * 0.75 if d is None else s * 0.65 + (0.35 if s > 0 else -0.35) * max(0.0, 1 - math.log1p(d) / 4.5)
        assert r.g.grade == sum(b > c for c in X.GRADE_CUTS) and abs(r.g.score - max(0, min(100, (b + 1) * 50))) < 0.006


def test_patterns(spark):
    texts = ["服后恶心呕吐，皮疹瘙痒", "口舌麻木，心悸", "一切正常"]
    out = X.extract_patterns(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", D.REACTION_PATTERNS).collect()
    got = {(r.id, r.reaction_type, r.matched_term, r.position) for r in out}
    assert got == {(0, "胃肠道反应", "恶心", 2), (0, "过敏反应", "皮疹", 7), (1, "神经系统", "口舌麻木", 0), (1, "心脏毒性", "心悸", 5)}


def test_profile_invariants(spark):
    cases = spark.createDataFrame([("f", 0.5, 3, 4.0), ("f", 0.1, 1, 0.0), ("g", -1.0, 0, None)], "name string, sentiment_score double, efficacy_grade int, days_to_effect double")
    out = {r.name: r for r in P.efficacy_profile(cases, ["name"]).collect()}
    assert out["f"].grade_distribution == {3: 1, 1: 1} and out["f"].avg_days_to_effect == 4.0
    assert out["f"].ci_low <= out["f"].avg_efficacy_score <= out["f"].ci_high
    assert out["g"].ci_low == out["g"].ci_high == 0.0 and out["g"].avg_days_to_effect == 0.0
    assert P.efficacy_profile(cases.limit(0), ["name"]).count() == 0


def test_review_flow(spark):
    queue = spark.createDataFrame([("c1", "2024-01-01 00:00:00")], "case_id string, t string").select("case_id", F.to_timestamp("t").alias("submitted_at"))
    none = spark.createDataFrame([], "case_id string, human_grade int, human_score double, ts timestamp")
    s = V.annotation_stats(queue, none).first()
    assert (s.total_annotated, s.pending_review, s.avg_human_score) == (0, 1, 0.0)
    done = spark.sql("select 'c1' case_id, 3 human_grade, 75.0D human_score, timestamp '2024-01-02 00:00:00' ts")
    s = V.annotation_stats(queue, done).first()
    assert (s.total_annotated, s.pending_review, s.avg_human_score, s.grade_3) == (1, 0, 75.0, 1)


def test_extraction_metrics(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b")], "id int, label string")
    e = spark.createDataFrame([(1, "a"), (2, "c")], p.schema)
    r = X.extraction_metrics(p, e, ["id", "label"]).first()
    assert (r.true_positive, r.false_positive, r.false_negative, r.f1) == (1, 1, 1, 0.5)
