from pyspark.sql import functions as F

from basketry.llm import language, registry


def test_held_out_accuracy(spark, tables):
    docs = registry.table(spark, tables, "documents")
    got = registry.QUERIES["op9_language_id"](spark, tables).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    assert got.count() == docs.count()
    ok = got.filter("held_out and n > 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert ok > 0.95
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_defined_cases(spark, docs):
    rows = [("the quick brown fox jumps", "en"), ("der schnelle braune fuchs", "de")] * 3 + [("the quick brown fox", None), (None, "fr")]
    train = spark.createDataFrame(rows, "text string, lang string")
    model = language.train(train, min_docs=1)
    assert sorted(model.languages) == ["de", "en"]
    texts = ["the brown quick fox", None, "", "123 !?", "der braune", "x", "der braune " * 20000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs(texts), model).collect()}
    assert [got[k][0] for k in (0, 4, 6)] == ["en", "de", "de"]
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[5][0] in ("de", "en")
    assert language.predict(docs([]), model).count() == 0
    none = language.train(train.filter("lang = 'xx'"))
    assert {r.lang_pred for r in language.predict(docs(texts), none).collect()} == {"und"}


def test_any_number_of_labels(spark, docs):
    words = {f"l{k:02d}": " ".join(chr(97 + (k * 7 + j * j * (k + 3)) % 26) + chr(97 + (k + j * 5) % 26) + f"{chr(97 + k % 26)}{chr(97 + k // 26)}xyz" for j in range(9)) for k in range(70)}
    rows = [(f"{text} {end}", lang) for lang, text in words.items() for end in ("one", "two")] + [("a lone text", "misspelt")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 70 and "misspelt" not in model.languages
    got = {r.doc_id: r.lang_pred for r in language.predict(docs(list(words.values())), model).collect()}
    assert [got[k] for k in range(70)] == list(words)
