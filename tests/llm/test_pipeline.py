import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import bpe, language, registry
from test_decontamination import brute as matches
from test_lines import brute as cleaned
from test_minhash import brute as classes


def grams(text):
    folded = re.sub(rb"[^a-z\x80-\xff]+", b" ", f" {text} ".lower().encode())
    return [folded[k:k + language.NGRAM] for k in range(len(folded) - language.NGRAM + 1)]


def in_a_language(rows):
    """Texts by doc_id that the first stage keeps, by exact sets of n-grams."""
    held = defaultdict(Counter)
    for lang, text in {(r.lang, r.text) for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}:
        held[lang].update(set(grams(text)))
    known = [{g for g, n in c.items() if n >= language.MIN_DOCS} for c in held.values()]
    out = {}
    for r in rows:
        letters = sum(c.isalpha() for c in r.text or "")
        if letters:
            share = max(sum(g in k for g in grams(r.text)) for k in known) / max(len(grams(r.text)), 1)
            if letters < corpus_pipeline.JUDGED or share >= corpus_pipeline.KNOWN:
                out[r.doc_id] = r.text
    return out


def test_language_stage_rejects_what_no_language_holds(spark, tables):
    rows = registry.table(spark, tables, "documents").select(*corpus_pipeline.COLUMNS)
    junk = [(-1, "qzkx wvjq xkzzq jjwqk vkqxz qqwzk", None, "s", 33), (-2, "привет как дела сегодня хорошо", None, "s", 30), (-3, "ok", None, "s", 2), (-4, None, None, "s", 0),
            (-5, "12 34 !", None, "s", 7), (None, "xqzk jvwq " * 50000, "en", "s", 500000)]
    mixed = rows.unionByName(spark.createDataFrame(junk, rows.schema)).withColumn("extra", F.lit(1))
    kept = corpus_pipeline.language_id(spark, mixed, tables)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    got = {r.doc_id for r in kept.collect()}
    assert {k for k in got if k is None or k < 0} == {-3}
    assert got - {-3} == set(in_a_language(rows.collect())) == {r.doc_id for r in rows.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_run_equals_brute_force(spark, tables):
    rows = registry.table(spark, tables, "documents").collect()
    items = {r.item_id: r.text for r in registry.table(spark, tables, "benchmark").collect()}
    texts = in_a_language(rows)
    texts = {k: t for k, (_, _, t) in cleaned(texts).items()}
    group = classes(texts)
    texts = {k: t for k, t in texts.items() if group[k] == k}
    leaks = {d for d, _ in matches(texts, items)}
    texts = {k: t for k, t in texts.items() if k not in leaks}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for k, t in texts.items():
        ids = library.encode_ordinary(t)
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, tables).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, tables, docs):
    empty = registry.table(spark, tables, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, tables)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.count() == 0


def test_unlabelled_corpus_is_kept(spark, tables):
    rows = [(k, t, None, "s", 1) for k, t in enumerate(["some text", None, "", "12 !?", "é"])]
    unlabelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, unlabelled, tables).collect()} == {0, 4}
