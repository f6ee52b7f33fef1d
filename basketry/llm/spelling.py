"""Spelling variants: groups of words that one inserted, deleted or replaced letter turns into each other.

1. Words are the maximal runs of letters of whole texts, counted over all documents (combined map-side).
2. Words of the same letters form a class. A class is a binary vector: one dimension per letter and occurrence number (the third
   ``a`` is a dimension of its own). One edit changes one or two dimensions: an insertion or deletion one, a replacement two.
3. PartEnum. A hash deals the dimensions to ``PARTS`` parts. Vectors at Hamming distance 2 at most differ in two parts at most, so
   they agree in all others: each class has a signature per choice of ``PARTS - 2`` parts, and near classes share one. The
   signatures are joined by equality. A pair that shares several is kept at one of them: where one part alone
   differs, at the choice that leaves out this part and the first other one.
4. Verification: the Hamming distance of the two classes by their dimensions' parities in 128 bits, which never loses a near pair, then the
   exact edit of their words. Words of a class are kept in chunks of about ``CHUNK``, so a class of any size is many
   rows, and pairs of words that are no variants never become rows.
5. A word's form is its near word of largest count, if it is common enough. Forms have ever larger counts, so chains are
   short; pointers are doubled until every word knows its last form.

Words of the same letters are never one edit apart, so a class is not compared with itself.
Counting is one shuffle of (word, count); all that follows is on the scale of the vocabulary.

Defined cases: null and empty texts hold no word; rows that repeat a doc_id are counted each, a null doc_id is the empty text before the
colon; words of any length; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut_lineage

#: Letters of a run; of these only A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]"
#: A run whose hash this number divides loses a letter (the planted misspellings).
DAMAGE = 199
#: Code points and occurrences that a word has at least; how often more frequent a form is at least.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: Parts of the dimensions, parts in which near vectors may differ, words of a class in one row.
PARTS, RADIUS, CHUNK = 7, 2, 128


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """``doc_id, run``: every lower-cased maximal run of at least ``least`` letters, as often as it occurs."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(f"{LETTERS}{{{least},}}"), 0)).alias("run"))


def damaged(doc_id: Column, run: Column, every: int = DAMAGE) -> Column:
    """The run without one of its letters where ``every`` divides the CRC-32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(words: DataFrame, word: str = "word", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    long = words.select(F.col(word).alias("word")).filter(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def letters_of(word: str) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def letter_classes(words: DataFrame) -> DataFrame:
    """``letters, length, size, parts, odd`` of each class: a hash of its dimensions in each part, and their parities in twice 64 bits."""
    counted = words.groupBy(letters_of("word").alias("letters")).agg(F.count(F.lit(1)).alias("size"))
    # letter and occurrence number: in sorted letters, places since the letter's first one
    dims = F.transform("_c", lambda c, i: F.shiftleft(F.ascii(c).cast("long"), 32) + i - F.array_position("_c", c) + 1)

    def folded(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))

    parts = F.array(*[folded(F.transform(F.filter("_d", lambda d: F.pmod(F.xxhash64(d), F.lit(PARTS)) == p), lambda d: F.xxhash64(d, F.lit(1)))) for p in range(PARTS)])
    one = F.lit(1).cast("long")
    odd = F.array(*[folded(F.transform("_d", lambda d: F.call_function("shiftleft", one, F.pmod(F.xxhash64(d, F.lit(seed)), F.lit(64)).cast("int")))) for seed in (2, 3)])
    return counted.withColumn("_c", F.split("letters", "")).withColumn("length", F.size("_c")).withColumn("_d", dims).select("letters", "length", "size", parts.alias("parts"), odd.alias("odd"))


def near_classes(classes: DataFrame) -> DataFrame:
    """``letters_a, letters_b``: pairs of classes that may differ in one dimension, or in two with as many letters; each once."""
    choices = list(itertools.combinations(range(PARTS), RADIUS))
    signatures = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.xxhash64(F.lit(u), F.lit(v), *[F.col("parts")[p] for p in range(PARTS) if p not in (u, v)]).alias("signature"),
                                    F.col("parts")[u].alias("part_u"), F.col("parts")[v].alias("part_v")) for u, v in choices])
    rows = classes.select("letters", "length", F.col("odd")[0].alias("odd_0"), F.col("odd")[1].alias("odd_1"), F.inline(signatures))
    a, b = rows.alias("a"), rows.alias("b")

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"a.{name}"), F.col(f"b.{name}")

    (ua, ub), (va, vb), (sa, sb) = both("u"), both("v"), both("signature")
    in_u, in_v = both("part_u")[0] != both("part_u")[1], both("part_v")[0] != both("part_v")[1]
    # where one part alone differs, the other one left out is the first of all others
    once = (in_u & in_v) | (in_u & (ua == 0) & (va == 1)) | (in_v & (ua == 0))
    flips = [F.bit_count(x.bitwiseXOR(y)) for x, y in (both("odd_0"), both("odd_1"))]
    (la, lb), (na, nb) = both("letters"), both("length")
    near = (flips[0] <= RADIUS) & (flips[1] <= RADIUS) & once & (F.abs(na - nb) <= 1) & (la < lb)
    return a.join(b, (sa == sb) & (ua == ub) & (va == vb) & near).select(la.alias("letters_a"), lb.alias("letters_b"))


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, n, near, near_n``: each word of ``words (word, n)``, all of ``least_length`` letters or more, beside each word one edit away."""
    classes = cut_lineage(letter_classes(words))
    named = words.withColumn("letters", letters_of("word"))
    chunked = named.join(classes.select("letters", "size"), "letters").withColumn("chunk", F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / CHUNK)))
    chunks = cut_lineage(chunked.groupBy("letters", "chunk").agg(F.collect_list(F.struct("word", "n")).alias("words")).drop("chunk"))
    # one edit leaves the first or the last letters of both words as they are, which is cheaper to see
    end = least_length // 2
    ready = {k: F.transform(f"words_{k}", lambda w: F.struct(w["word"].alias("word"), w["n"].alias("n"), F.left(w["word"], F.lit(end)).alias("first"), F.right(w["word"], F.lit(end)).alias("last"))) for k in "ab"}
    both = near_classes(classes).join(chunks.withColumnsRenamed({"letters": "letters_a", "words": "words_a"}), "letters_a").join(
        chunks.withColumnsRenamed({"letters": "letters_b", "words": "words_b"}), "letters_b").select(ready["a"].alias("words_a"), ready["b"].alias("words_b"))
    found = F.flatten(F.transform("words_a", lambda x: F.transform(
        F.filter("words_b", lambda y: ((x["first"] == y["first"]) | (x["last"] == y["last"])) & (F.levenshtein(x["word"], y["word"], 1) == 1)),
        lambda y: F.struct(x["word"].alias("word"), x["n"].alias("n"), y["word"].alias("near"), y["n"].alias("near_n")))))
    once = both.select(F.explode(found).alias("e"))
    return once.select(F.explode(F.array("e", F.struct(F.col("e.near").alias("word"), F.col("e.near_n").alias("n"), F.col("e.word").alias("near"), F.col("e.n").alias("near_n")))).alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``forms (word, form)``: the last form that following forms reaches. Counts rise along a chain, so there is no cycle."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(state.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        state = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return state


def variants(words: DataFrame, form_factor: int = FORM_FACTOR, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words (word, n)``."""
    words = cut_lineage(words)
    best = near_words(words, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_n"), F.col("near").alias("form"))).alias("_best"))
    good = -F.col("_best._n") >= form_factor * F.col("n")
    known = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("_best.form")).alias("form"), F.when(good, -F.col("_best._n")).alias("form_n")))
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants among the words of whole texts, with the planted misspellings."""
    return variants(vocabulary(runs(docs, doc_id, text, LEAST_LENGTH).select(damaged(F.col("doc_id"), F.col("run")).alias("word"))))


SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM low) GROUP BY ALL),
t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM (SELECT unnest(range(256)) AS i))),
b AS (SELECT doc_id, run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(bytes, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, t),
d AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
g AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
e AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM g a JOIN w b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM g a JOIN w b ON a.rest = b.word),
f AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM e GROUP BY word, n),
q AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN f USING (word)),
c AS (SELECT word, form, form AS root, 1 AS step FROM q WHERE form IS NOT NULL),
s AS (SELECT a.word, coalesce(e4.form, e3.form, e2.form, e1.form, a.root) AS root FROM c a LEFT JOIN c e1 ON e1.word = a.root LEFT JOIN c e2 ON e2.word = e1.form LEFT JOIN c e3 ON e3.word = e2.form
  LEFT JOIN c e4 ON e4.word = e3.form)
SELECT q.word, q.form, coalesce(s.root, q.word) AS root, q.n, q.n_near, q.form_n FROM q LEFT JOIN s ON s.word = q.word
"""
