"""The summary of an indication: its trials, pooled effect, network and best profiles in one row."""

from basketry.operators import profiles as P


def test_indication_summary(spark):
    trials = spark.createDataFrame([("t1", "x", 2001), ("t2", "x", 2005), ("t3", "y", 2003)], "trial_id string, indication string, year int")
    arms = spark.createDataFrame([("t1", 10), ("t1", 12), ("t2", 5), ("t3", 7)], "trial_id string, sample_size long")
    pooled = spark.createDataFrame([("x", 0.4, 2)], "indication string, pooled_effect_size double, trials_included long")
    ranking = spark.createDataFrame([("x", "b", 2, 0.1), ("x", "a", 1, 0.9)], "indication string, treatment string, rank int, net_score double")
    profiles = spark.createDataFrame([(k, 50.0 + k, 3.0) for k in range(12)] + [(99, 80.0, 1.0)], "name long, avg_efficacy_score double, avg_days_to_effect double")
    assessed = spark.createDataFrame([(11, 60.0, "high"), (10, None, None)], "name long, risk_score double, risk_level string")
    labels = spark.createDataFrame([(k, "x") for k in range(12)] * 2 + [(99, "z"), (5, None)], "name long, indication string")
    rows = {r.indication: r for r in P.indication_summary(trials, arms, pooled, ranking, profiles, assessed, labels, "name", 3).collect()}
    assert set(rows) == {"x", "y"}
    x, y = rows["x"], rows["y"]
    assert (x.trials, x.first_year, x.last_year, x.total_patients) == (2, 2001, 2005, 27)
    assert x.meta.pooled_effect_size == 0.4 and [t.treatment for t in x.network] == ["a", "b"]
    # 11 loses 60 / 5 = 12 of its 61 points
    assert [(t.rank, t.name, t.value) for t in x.top_by_value] == [(1, 10, 60.0), (2, 9, 59.0), (3, 8, 58.0)]
    assert (y.trials, y.total_patients, y.meta, y.network, y.top_by_value) == (1, 7, None, [], [])


def test_score_lookup_of_unknown_and_repeated_names(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "name string")
    profiles = spark.createDataFrame([("a", 70.0), ("c", 10.0)], "name string, avg_efficacy_score double")
    assert {r.name: r.avg_efficacy_score for r in P.score_lookup(asked, profiles).collect()} == {"a": 70.0, "b": None, None: None}
    assert P.score_lookup(asked, profiles).count() == 3
