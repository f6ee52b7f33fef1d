"""Text scoring, pattern extraction, review queue and efficacy profiles over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import profiles as P, review as V, text as X
from . import bindings as Bd
from .catalog import Tables, query, with_ctes

#: Word lists for the invented prose of the documents (frequent fragments of its four languages).
LEXICON = X.Lexicon(
    positive={"tion": 0.35, "ment": 0.45, "keit": 0.55, "dad": 0.5, "eaux": 0.6, "the": 0.25},
    negative={"pas": -0.7, "nicht": -0.6, "sh": -0.4, "über": -0.5},
    intensifiers={"en": 1.3, "a": 1.15},
    negations=["i", "n", "r"],
    time_patterns=[("[Uu]nd der", 3), ("ent que", 7), ("zz+", 14), ("ing ", 1), ("ción", 30)],
)
PATTERNS = [
    (r"([a-z0-9._]+@[a-z0-9.]+)", "mail", "high"),
    (r"(\d{3}-\d{4})", "phone", "medium"),
    (r"([Ll]icense|[Cc]opyright)", "license", "low"),
    (r"(\d+\.\d+\.\d+\.\d+)", "address", "high"),
    (r"(the \w+)", "phrase", "low"),
]


def lexicon_sql(lex: X.Lexicon, source: str, text: str = "text") -> list[tuple[str, str]]:
    """CTEs up to ``ana``: per keyword its position and weight, then one step per keyword for whether it is taken."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    kws = lex.ordered()
    idx = range(len(kws))
    cols = [f"strpos({text}, {q(k)}) AS p{i}" for i, (k, _, _) in enumerate(kws)]
    cols += [f"length({text}) AS len", f"{days_sql(lex, text)} AS days"]
    for i, (k, w, kind) in enumerate(kws):
        mod = "1.0"
        if kind == "pos":
            at = f"strpos({text}, {q(k)})"
            boost = "CASE " + " ".join(f"WHEN strpos({text}, {q(b + k)}) > 0 THEN {m}" for b, m in lex.intensifiers.items()) + " ELSE 1.0 END"
            neg = ", ".join(q(n) for n in lex.negations)
            mod = f"CASE WHEN {at} > 1 AND substr({text}, CAST({at} - 1 AS BIGINT), 1) IN ({neg}) THEN -0.8 ELSE {boost} END"
        cols.append(f"CAST({w} AS DOUBLE) * ({mod}) AS f{i}")
    out = [("h", f"SELECT doc_id, source, lang, {', '.join(cols)} FROM {source}")]
    prev = "h"
    for i, (k, _, _) in enumerate(kws):
        clash = " OR ".join(f"(t{j} AND p{i} < p{j} + {len(kws[j][0])} AND p{j} < p{i} + {len(k)})" for j in range(i)) or "false"
        out.append((f"h{i}", f"SELECT *, p{i} > 0 AND NOT ({clash}) AS t{i} FROM {prev}"))
        prev = f"h{i}"
    taken = ", ".join(f"CASE WHEN t{i} THEN f{i} ELSE 0.0 END AS w{i}" for i in idx)
    n = " + ".join(f"CAST(t{i} AS INTEGER)" for i in idx)
    out.append(("hit", f"SELECT *, {n} AS n, {taken} FROM {prev}"))
    pos = " + ".join(f"abs(w{i})" for i in idx if kws[i][2] == "pos")
    neg = " + ".join(f"abs(w{i})" for i in idx if kws[i][2] == "neg")
    out.append(("sums", f"SELECT *, {' + '.join(f'w{i}' for i in idx)} AS total, {pos} AS wpos, {neg} AS wneg, ({pos} + {neg}) / greatest(n, 1) AS meanw FROM hit"))
    spread = " + ".join(f"CASE WHEN t{i} THEN (abs(w{i}) - meanw) * (abs(w{i}) - meanw) ELSE 0.0 END" for i in idx)
    out.append(("vars", f"SELECT *, ({spread}) / greatest(n, 1) AS varw FROM sums"))
    out.append(("sent", (
        "SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, total / n * 1.2)) END AS s, "
        "CASE WHEN wpos + wneg = 0 THEN 1.0 ELSE CASE WHEN wpos > 0 THEN -(wpos / (wpos + wneg)) * log2(wpos / (wpos + wneg)) ELSE 0 END + "
        "CASE WHEN wneg > 0 THEN -(wneg / (wpos + wneg)) * log2(wneg / (wpos + wneg)) ELSE 0 END END AS ent, "
        "CASE WHEN n = 0 THEN 0.0 ELSE 0.6 * (1 - exp(-n / 2.0)) + 0.4 * least(1.0, n / greatest(len / 3.0, 1.0)) END AS mc, "
        "CASE WHEN n > 1 THEN least(1.0, sqrt(varw)) ELSE 0.0 END AS spread FROM vars")))
    out.append(("ana", "SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, 1 - (0.4 * ent + 0.35 * (1 - mc) + 0.25 * spread)) END AS conf FROM sent"))
    return out


def days_sql(lex: X.Lexicon, text: str = "text") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN CAST({d} AS DOUBLE)" for p, d in lex.time_patterns) + " END"


def grade_sql(sentiment: str, days: str, conf: str, source: str) -> list[tuple[str, str]]:
    bounds = [-1.0, *X.GRADE_CUTS, 1.0]
    probs = ", ".join(f"greatest(0.01, 1 - abs(b - ({(lo + hi) / 2!r})) / {hi - lo!r}) * gconf AS r{i}" for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])))
    rs = ", ".join(f"r{i}" for i in range(5))
    return [
        ("g0", f"SELECT *, {sentiment} AS gs, {days} AS gd, {conf} AS gconf FROM {source}"),
        ("gb", "SELECT *, CASE WHEN gd IS NULL THEN gs * 0.75 ELSE gs * 0.65 + CASE WHEN gs > 0 THEN 0.35 ELSE -0.35 END * greatest(0.0, 1 - ln(1 + gd) / 4.5) END AS bs FROM g0"),
        ("g1", "SELECT *, CASE WHEN bs > 0.8 THEN 4 WHEN bs > 0.55 THEN 3 WHEN bs > 0.2 THEN 2 WHEN bs > -0.3 THEN 1 ELSE 0 END AS grade, "
               "round(round(greatest(0.0, least(100.0, (bs + 1) * 50)), 9), 2) AS score FROM gb"),
        ("gp", "SELECT *, score / 100.0 * 2 - 1 AS b FROM g1"),
        ("gr", f"SELECT *, {probs} FROM gp"),
        ("gt", f"SELECT *, {rs.replace(', ', ' + ')} AS rt, list_sort([{rs}]) AS rs FROM gr"),
        ("gm", "SELECT *, CASE WHEN rt > 0 THEN (rs[5] - rs[4]) / rt ELSE 0.0 END AS margin FROM gt"),
        ("gu", "SELECT *, 0.4 * (1 - margin) + 0.6 * (1 - gconf) AS unc FROM gm"),
        ("g2", "SELECT *, CASE WHEN unc < 0.25 THEN 'low' WHEN unc < 0.45 THEN 'medium' ELSE 'high' END AS ulevel FROM gu"),
    ]


ANALYZED = lexicon_sql(LEXICON, "documents")
GRADED = [*ANALYZED, *grade_sql("round(s, 4)", "days", "round(conf, 4)", "ana")]


def _evaluated(t: Tables) -> DataFrame:
    return X.evaluate_texts(t.documents.select("doc_id", "source", "lang", "text"), "text", LEXICON)


@query("lexicon_sentiment", with_ctes(*ANALYZED, body="SELECT doc_id, round(s, 6) AS sentiment FROM ana"))
def lexicon_sentiment(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(X.lexicon_sentiment("text", LEXICON), 6).alias("sentiment"))


@query("sentiment_hits", with_ctes(*ANALYZED, ("rows", " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS keyword, round(w{i}, 6) AS weight, '{kind}' AS type, CAST(p{i} - 1 AS INTEGER) AS position FROM hit WHERE t{i}"
    for i, (k, _, kind) in enumerate(LEXICON.ordered()))), body="SELECT * FROM rows"))
def sentiment_hits(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", F.explode(X.lexicon_hits("text", LEXICON)["hits"]).alias("h"))
    return hits.select("doc_id", "h.keyword", F.round("h.weight", 6).alias("weight"), "h.type", "h.position")


@query("sentiment_uncertainty", with_ctes(*ANALYZED, body=(
    "SELECT doc_id, round(s, 4) AS sentiment_score, n AS match_count, round(ent, 4) AS entropy, round(1 - mc, 4) AS sparsity_penalty, round(spread, 4) AS weight_variance, "
    "CASE WHEN conf > 0.7 THEN 'low' WHEN conf > 0.45 THEN 'medium' ELSE 'high' END AS ambiguity_level, round(mc, 4) AS match_confidence, round(conf, 4) AS overall_confidence, "
    "conf < 0.5 OR n <= 1 AS needs_human_review FROM ana")))
def sentiment_uncertainty(t: Tables) -> DataFrame:
    return X.analyze_texts(t.documents.select("doc_id", "text"), "text", LEXICON).drop("text", "matched_keywords")


@query("extract_days", f"SELECT doc_id, {days_sql(LEXICON)} AS days FROM documents")
def extract_days(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.extract_days("text", LEXICON.time_patterns).alias("days"))


FOUND = ("found", " UNION ALL ".join(
    f"SELECT doc_id, source, '{kind}' AS reaction_type, '{sev}' AS severity, regexp_extract(text, '{p}', 1) AS matched_term FROM documents WHERE regexp_matches(text, '{p}')"
    for p, kind, sev in PATTERNS))


def _found(t: Tables) -> DataFrame:
    return X.extract_patterns(t.documents.select("doc_id", "source", "text"), "text", PATTERNS)


@query("extract_patterns", with_ctes(FOUND, body="SELECT found.doc_id, reaction_type, severity, matched_term FROM found"))
def extract_patterns(t: Tables) -> DataFrame:
    return _found(t).select("doc_id", "reaction_type", "severity", "matched_term")


@query("pattern_positions", with_ctes(("f", " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS reaction_type, CAST(strpos(text, regexp_extract(text, '{p}', 1)) - 1 AS INTEGER) AS position FROM documents WHERE regexp_matches(text, '{p}')"
    for p, kind, sev in PATTERNS if kind != "phrase")), body="SELECT * FROM f"))
def pattern_positions(t: Tables) -> DataFrame:
    return _found(t).filter("reaction_type <> 'phrase'").select("doc_id", "reaction_type", "position")


@query("aggregate_reactions", with_ctes(FOUND, body="SELECT source, reaction_type, severity, count(*) AS count FROM found GROUP BY 1, 2, 3"))
def aggregate_reactions(t: Tables) -> DataFrame:
    return X.aggregate_reactions(_found(t), ["source"])


@query("reaction_totals", with_ctes(FOUND, body=(
    "SELECT s.source, CAST(sum(c) AS BIGINT) AS total_reactions, string_agg(severity || ':' || c, ';' ORDER BY severity) AS severities, any_value(k.kinds) AS kinds FROM "
    "(SELECT source, severity, count(*) AS c FROM found GROUP BY 1, 2) s JOIN (SELECT source, string_agg(reaction_type || ':' || c, ';' ORDER BY reaction_type) AS kinds FROM "
    "(SELECT source, reaction_type, count(*) AS c FROM found GROUP BY 1, 2) GROUP BY 1) k ON k.source = s.source GROUP BY s.source")))
def reaction_totals(t: Tables) -> DataFrame:
    def said(column: str):
        return F.array_join(F.transform(F.array_sort(F.map_keys(column)), lambda k: F.concat(k, F.lit(":"), F.element_at(column, k).cast("string"))), ";")

    return X.reaction_totals(_found(t), ["source"]).select("source", "total_reactions", said("severity_distribution").alias("severities"), said("by_reaction_type").alias("kinds"))


@query("ordinal_grades", with_ctes(*GRADED, body="SELECT doc_id, grade, score FROM g1"))
def ordinal_grades(t: Tables) -> DataFrame:
    scored = t.documents.select("doc_id", F.round(X.lexicon_sentiment("text", LEXICON), 4).alias("s"), X.extract_days("text", LEXICON.time_patterns).alias("d"))
    g = scored.withColumn("g", X.ordinal_grade("s", "d"))
    return g.select("doc_id", "g.grade", "g.score")


@query("evaluate_texts", with_ctes(*GRADED, body=(
    "SELECT doc_id, gs AS sentiment_score, gd AS days_to_effect, grade, score, round(b, 4) AS base_score, round(CASE WHEN rt > 0 THEN r0 / rt ELSE r0 END, 4) AS p0, "
    "round(CASE WHEN rt > 0 THEN r4 / rt ELSE r4 END, 4) AS p4, round(margin, 4) AS confidence_margin, ulevel AS uncertainty_level, ulevel = 'high' OR gconf < 0.5 AS grade_needs_review FROM g2")))
def evaluate_texts(t: Tables) -> DataFrame:
    p = F.col("grade_probabilities")
    return _evaluated(t).select("doc_id", "sentiment_score", "days_to_effect", "grade", "score", "base_score", p[0].alias("p0"), p[4].alias("p4"),
                                "confidence_margin", "uncertainty_level", "grade_needs_review")


CASES = ("cases", "SELECT doc_id, source, grade AS efficacy_grade, gs AS sentiment_score, gd AS days_to_effect, grade * 25 + (gs + 1) * 12.5 AS sc FROM g2")


def _cases(t: Tables) -> DataFrame:
    return _evaluated(t).select("doc_id", "source", F.col("grade").alias("efficacy_grade"), "sentiment_score", "days_to_effect")


PROFILE = ("prof", "SELECT source, avg(sc) AS m, count(*) AS n, CASE WHEN count(*) > 1 THEN sqrt(var_samp(sc) / count(*)) ELSE 0 END AS se, "
                   "coalesce(avg(CASE WHEN days_to_effect <> 0 THEN days_to_effect END), 0) AS d FROM cases GROUP BY source")


@query("efficacy_profile", with_ctes(*GRADED, CASES, PROFILE, body=(
    "SELECT source, round(m, 8) AS avg_efficacy_score, n AS total_cases, round(d, 4) AS avg_days_to_effect, round(greatest(0, m - 1.96 * se), 6) AS ci_low, round(least(100, m + 1.96 * se), 6) AS ci_high FROM prof")))
def efficacy_profile(t: Tables) -> DataFrame:
    out = P.efficacy_profile(_cases(t), ["source"])
    return out.select("source", "total_cases", *[F.round(c, d).alias(c) for c, d in (("avg_efficacy_score", 8), ("avg_days_to_effect", 4), ("ci_low", 6), ("ci_high", 6))])


@query("grade_histogram", with_ctes(*GRADED, CASES, body="SELECT source, efficacy_grade, count(*) AS count FROM cases GROUP BY 1, 2"))
def grade_histogram(t: Tables) -> DataFrame:
    return P.grade_histogram(_cases(t), ["source"])


@query("grade_map", with_ctes(*GRADED, CASES, body="SELECT source, efficacy_grade AS grade, count(*) AS cases FROM cases GROUP BY 1, 2"))
def grade_map(t: Tables) -> DataFrame:
    prof = P.efficacy_profile(_cases(t), ["source"])
    return prof.select("source", F.explode("grade_distribution").alias("grade", "cases"))


@query("ranked_profiles", with_ctes(*GRADED, CASES, PROFILE, body=(
    "SELECT source, round(m, 8) AS avg_efficacy_score, n AS total_cases, (SELECT count(*) FROM prof WHERE n >= 3) AS total FROM prof WHERE n >= 3 ORDER BY m DESC, source LIMIT 10 OFFSET 2")))
def ranked_profiles(t: Tables) -> DataFrame:
    out = P.rank_profiles(P.efficacy_profile(_cases(t), ["source"]), "source", 3, 2, 10)
    return out.select("source", F.round("avg_efficacy_score", 8).alias("avg_efficacy_score"), "total_cases", "total")


EXPECTED = "SELECT doc_id, 'toxic' AS label FROM labels WHERE toxic = 1"
PREDICTED = "SELECT doc_id, 'toxic' AS label FROM ana JOIN labels USING (doc_id) WHERE s < 0"


@query("extraction_metrics", with_ctes(*ANALYZED, ("p", PREDICTED), ("e", EXPECTED), (
    "c", "SELECT (SELECT count(*) FROM p JOIN e USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM e) AS ne"), body=(
    "SELECT tp AS true_positive, np - tp AS false_positive, ne - tp AS false_negative, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 6) AS precision, "
    "round(CASE WHEN ne > 0 THEN tp / ne ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (np + ne) ELSE 0 END, 6) AS f1 FROM c")))
def extraction_metrics(t: Tables) -> DataFrame:
    scored = t.documents.select("doc_id", X.lexicon_sentiment("text", LEXICON).alias("s")).join(t.labels.select("doc_id"), "doc_id")
    predicted = scored.filter("s < 0").select("doc_id", F.lit("toxic").alias("label"))
    expected = t.labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("label"))
    out = X.extraction_metrics(predicted, expected, ["doc_id", "label"])
    return out.select("true_positive", "false_positive", "false_negative", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# --- review queue: uncertain documents, submitted and annotated at times taken from the events ---------------

_DAY = "INTERVAL 1 DAY"
QUEUE = [*GRADED, ("queue", "SELECT doc_id AS case_id, grade AS auto_grade, score AS auto_score, ulevel AS uncertainty, "
                            "CASE WHEN (conf < 0.5 OR n <= 1) AND (ulevel = 'high' OR gconf < 0.5) THEN 'sentiment and grade' WHEN conf < 0.5 OR n <= 1 THEN 'sentiment' ELSE 'grade' END AS reason, "
                            "TIMESTAMP '2024-01-10 00:00:00' + CAST(doc_id % 7 AS INTEGER) * INTERVAL 1 DAY AS submitted_at FROM g2 WHERE conf < 0.5 OR n <= 1 OR ulevel = 'high' OR gconf < 0.5")]
ANNOTATIONS = ("annotations", "SELECT user_id AS case_id, CAST(CAST(floor(value) AS BIGINT) % 5 AS INTEGER) AS human_grade, value AS human_score, ts, event_id FROM events WHERE event_type = 'click'")
LATEST = ("latest", "SELECT * FROM annotations QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, human_score DESC) = 1")
PENDING = ("pending", "SELECT queue.* FROM queue WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.case_id = queue.case_id AND a.ts >= queue.submitted_at)")


def _queue(t: Tables) -> DataFrame:
    submitted = F.to_timestamp(F.lit("2024-01-10 00:00:00")) + F.make_dt_interval(F.col("doc_id") % 7)
    return V.review_candidates(_evaluated(t), "doc_id", "text", submitted)


def _annotations(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'click'").select(
        F.col("user_id").alias("case_id"), (F.floor("value") % 5).cast("int").alias("human_grade"), F.col("value").alias("human_score"), "ts")


@query("review_candidates", with_ctes(*QUEUE, body=(
    "SELECT case_id, auto_grade, auto_score, uncertainty, reason, text FROM queue JOIN (SELECT doc_id, text FROM documents) d ON d.doc_id = queue.case_id")))
def review_candidates(t: Tables) -> DataFrame:
    return _queue(t).select("case_id", "auto_grade", "auto_score", "uncertainty", "reason", "text")


@query("latest_annotations", with_ctes(ANNOTATIONS, LATEST, body="SELECT case_id, human_grade, human_score FROM latest"))
def latest_annotations(t: Tables) -> DataFrame:
    return V.latest_annotations(_annotations(t)).select("case_id", "human_grade", "human_score")


@query("pending_reviews", with_ctes(*QUEUE, ANNOTATIONS, PENDING, body="SELECT case_id, reason FROM pending"))
def pending_reviews(t: Tables) -> DataFrame:
    return V.pending_reviews(_queue(t), _annotations(t)).select("case_id", "reason")


@query("annotation_stats", with_ctes(*QUEUE, ANNOTATIONS, LATEST, PENDING, body=(
    "SELECT count(*) AS total_annotated, round(avg(human_score), 4) AS avg_human_score, (SELECT count(*) FROM pending) AS pending_review, "
    + ", ".join(f"count(*) FILTER (human_grade = {g}) AS grade_{g}" for g in range(5)) + " FROM latest")))
def annotation_stats(t: Tables) -> DataFrame:
    return V.annotation_stats(_queue(t), _annotations(t)).withColumn("avg_human_score", F.round("avg_human_score", 4))
