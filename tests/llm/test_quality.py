import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from basketry.llm import quality, registry

TEXTS = ["The quick fox.\nIt ran!", "", None, "WOW!! WOW!! $$$ a$$$ b$$$", "é à ç\n\nx y z", "...", "a a a a b a", "Ein Wort\tund 12 Zahlen: 3,5", "longlonglongword " * 30]


def plain(text):
    """The statistics again, letter by letter."""
    data = (text or "").encode()
    n = max(len(data), 1)
    out = {k: sum(b in v for b in data) for k, v in quality.CLASSES.items()}
    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    some, lines = max(len(runs), 1), data.count(b"\n") + 1
    letters = out["upper"] + out["lower"]
    mean = sum(map(len, runs)) / some
    skip = quality.CLASSES["lower"] + quality.CLASSES["blank"]
    marks = quality.CLASSES["symbol"] + quality.CLASSES["call"]
    key = [(len(w), w[:6]) for w in runs]
    extra = [
        math.log1p(len(data)), out["upper"] / max(letters, 1), mean, math.sqrt(max(sum(len(w) ** 2 for w in runs) / some - mean**2, 0)), sum(len(w) <= 3 for w in runs) / some,
        sum(len(w) >= 12 for w in runs) / some, len(data) / lines, len(runs) / lines, sum(line[-1:] in (b".", b"!", b"?") for line in data.split(b"\n") if line) / lines,
        sum(a == b and b not in skip for a, b in zip(data, data[1:])) / n, sum(a in marks and b in quality.CLASSES["blank"] for a, b in zip(data, data[1:])) / max(out["blank"], 1),
        sum(a == b for a, b in zip(key, key[1:])) / some, sum(k in key[max(i - 4, 0):max(i - 1, 0)] for i, k in enumerate(key)) / some,
    ]
    return [out[k] / n for k in quality.CLASSES] + extra


def walked(trees, row):
    """One row down one tree after the other."""
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        k = 0
        while k < len(feature):
            k = 2 * k + (2 if row[feature[k]] > threshold[k] else 1)
        total += leaf[k - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_statistics_equal_plain_ones():
    got = quality.statistics(pa.array(TEXTS))
    assert got.shape == (len(TEXTS), len(quality.FEATURES))
    np.testing.assert_allclose(got, [plain(t) for t in TEXTS], atol=1e-12)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def test_query_by_hand(spark, tables):
    """The query's scores are those of its trees walked node by node over plain statistics."""
    docs, labels = (registry.table(spark, tables, t) for t in ("documents", "labels"))
    got = {r.doc_id: r for r in registry.QUERIES["op11_quality_classifier"](spark, tables).collect()}
    assert len(got) == docs.count()
    trees = quality.train(docs, labels.filter(~quality.held_out()).select("doc_id", F.col("quality").alias("y")))
    for r in docs.select("doc_id", "text").collect():
        want = walked(trees, plain(r.text))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == int(want >= 0.5)


def test_held_out_accuracy(spark, tables):
    big = tables.replace("sf0.001", "sf0.01")
    got = registry.QUERIES["op11_quality_classifier"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and (got[got.quality == 1].predicted == 1).mean() > 0.97


def test_cut_is_the_best_one():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 8, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    tree = quality.grown(x, y, trees=1, depth=1, bins=16)
    p = 1 / (1 + math.exp(-tree.base))
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(f, t):
        low = x[:, f] <= t
        if min(h[low].sum(), h[~low].sum()) < quality.LEAST_WEIGHT:
            return -1.0
        return sum(g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE) for m in (low, ~low))

    best = max(gain(f, t) for f in range(3) for t in range(8))
    assert abs(gain(tree.feature[0, 0], tree.threshold[0, 0]) - best) < 1e-9


def test_defined_cases(spark, docs):
    texts = ["Good words here.", None, "", "BAD!! BAD!!", "x", "Long text. " * 50000] + ["Good words here.", "BAD!! BAD!!"] * 20
    rows = docs(texts)
    none = spark.createDataFrame([], "doc_id bigint, quality int, text string")
    assert {round(r.score, 6) for r in quality.scored(rows, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, "z"), (6, 1, "z")], "doc_id bigint, quality int, text string")
    assert len({r.score for r in quality.scored(rows, one).collect()}) == 1
    marks = [(k, int(k % 2 == 0), "z") for k in range(6, 46)] * 2 + [(None, 1, "z"), (3, None, "z"), (4, 0, "z"), (4, 1, "z"), (5, 7, "z")]
    got = quality.scored(rows.union(rows.limit(1)), spark.createDataFrame(marks, "doc_id bigint, quality int, text string")).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[0], by[3]) == (1, 0)
    assert quality.scored(docs([]), none).count() == 0


def test_sample_is_bounded(spark):
    labelled = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    sample = quality.sample_ids(labelled, 500)
    assert 480 <= sample.count() <= 500 and sample.select("doc_id").distinct().count() == sample.count()
    assert sorted(quality.sample_ids(labelled.repartition(7), 500).collect()) == sorted(sample.collect())
