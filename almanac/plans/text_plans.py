"""Queries for text selection and search (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import search, text
from almanac.operators.upsert import scoped_replace
from almanac.plans.registry import query
from almanac.plans.tables import table
from almanac.session import join_counted, materialise, spread

LEXICON = text.lexicon_pattern(["that", "with", "this"], ["th*"])
NARROW_LEXICON = text.lexicon_pattern(["that", "with", "this"])

# Words and the gaps before them; a keyword is a whole word, so hits are chosen words.
_W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
IS_HIT = "(lower(word) IN ('that', 'with', 'this') OR starts_with(lower(word), 'th'))"
HITS_SQL = f"""w AS (SELECT doc_id, source, regexp_extract_all(text, '{_W}') AS ws,
        string_split_regex(text, '{_W}') AS gs FROM documents),
    words AS (SELECT doc_id, source, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap,
        unnest(range(1, len(ws) + 1)) AS i FROM w),
    placed AS (SELECT doc_id, source, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i)
        AS BIGINT) AS e FROM words),
    hits AS (SELECT doc_id, source, lower(word) AS keyword, e - length(word) AS s, e,
        row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS pos FROM placed WHERE {IS_HIT})"""
SPANS_SQL = HITS_SQL + """,
    breaks AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY doc_id ORDER BY s) <= 15 THEN 0 ELSE 1 END AS b FROM hits),
    islands AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM breaks),
    spans AS (SELECT doc_id, source, island - 1 AS pos, string_agg(keyword, ', ' ORDER BY s) AS keywords,
        min(s) AS s, max(e) AS e FROM islands GROUP BY doc_id, source, island)"""


def documents(spark, sf):
    return spread(table(spark, sf, "documents"))


@query("t01_lexicon_hits_by_lang", f"""WITH {HITS_SQL} SELECT lang, count(*) AS hits, CAST(sum(s) AS BIGINT) AS start_sum
    FROM hits JOIN documents USING (doc_id) GROUP BY lang""")
def t01(spark, sf):
    hits = text.keyword_hits(documents(spark, sf), "doc_id", "text", LEXICON, carry=["lang"])
    return hits.groupBy("lang").agg(F.count("*").alias("hits"), F.sum("start").alias("start_sum"))


@query("t02_page_filter", f"WITH {HITS_SQL} SELECT DISTINCT doc_id FROM hits")
def t02(spark, sf):
    return documents(spark, sf).where(text.has_keyword(F.col("text"), LEXICON)).select("doc_id")


@query("t03_distinct_keywords", f"""WITH {HITS_SQL}, f AS (SELECT doc_id, keyword, min(s) AS s FROM hits GROUP BY ALL)
    SELECT doc_id, string_agg(keyword, ' ' ORDER BY s) AS keywords FROM f GROUP BY doc_id""")
def t03(spark, sf):
    words = text.distinct_keywords(F.col("text"), LEXICON)
    return (
        documents(spark, sf)
        .where(text.has_keyword(F.col("text"), LEXICON))
        .select("doc_id", F.array_join(words, " ").alias("keywords"))
    )


@query("t04_keyword_hits", f"""WITH {HITS_SQL} SELECT doc_id, keyword, s AS "start", e AS "end" FROM hits""")
def t04(spark, sf):
    hits = text.keyword_hits(documents(spark, sf), "doc_id", "text", LEXICON)
    return hits.select("doc_id", "keyword", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


@query("t05_keyword_spans", f"""WITH {SPANS_SQL} SELECT doc_id, keywords, s AS "start", e AS "end" FROM spans""")
def t05(spark, sf):
    spans = text.keyword_spans(documents(spark, sf), "doc_id", "text", LEXICON)
    return spans.select("doc_id", "keywords", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


@query("t05_merge_listed_hits", f"""WITH {SPANS_SQL} SELECT doc_id, keywords, s AS "start", e AS "end" FROM spans""")
def t05_listed(spark, sf):
    hits = text.keyword_hits(documents(spark, sf), "doc_id", "text", LEXICON)
    spans = text.merge_hits(hits, "doc_id")
    return spans.select("doc_id", "keywords", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


WINDOWS_SQL = SPANS_SQL + """,
    edged AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY s) AS pe, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS ns
        FROM spans),
    windows AS (SELECT doc_id, pos, substr(text, greatest(0, s - least(500, coalesce((s - pe) // 2, 500))) + 1,
        least(length(text), e + least(500, coalesce((ns - e) // 2, 500)))
        - greatest(0, s - least(500, coalesce((s - pe) // 2, 500)))) AS chunk_text FROM edged JOIN documents USING (doc_id))"""


@query("t06_context_windows", f"""WITH {WINDOWS_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, chunk_text FROM windows""")
def t06(spark, sf):
    return text.context_windows(documents(spark, sf), "doc_id", "text", LEXICON)


CHUNKS_SQL = r"""cut AS (SELECT doc_id, text AS rest, CAST(NULL AS VARCHAR) AS piece, 0 AS step FROM documents
    UNION ALL SELECT doc_id, substr(rest, cutat + 1), left(rest, cutat), step + 1 FROM (
        SELECT doc_id, rest, step, CASE WHEN length(rest) <= 500 THEN length(rest)
            WHEN length(regexp_extract(left(rest, 500), '(?s)^(.*) ', 1)) > 0
            THEN length(regexp_extract(left(rest, 500), '(?s)^(.*) ', 1)) ELSE 500 END AS cutat
        FROM cut WHERE length(rest) > 0)),
    trimmed AS (SELECT doc_id, step, regexp_replace(piece, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS c FROM cut WHERE step > 0),
    chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_index,
        c AS chunk_text FROM trimmed WHERE c <> '')"""


@query("t07_fixed_chunks", f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, chunk_index, chunk_text FROM chunks")
def t07(spark, sf):
    return text.fixed_chunks(documents(spark, sf), "doc_id", "text")


ROLLUP_SQL = """SELECT source, count(*) FILTER (n > 0) AS pages_with_hits, count(*) AS total_pages,
    CAST(sum(n) AS BIGINT) AS spans, CAST(count(*) FILTER (n > 0) / count(*) AS DECIMAL(6,5)) AS hit_rate
    FROM (SELECT doc_id, d.source, count(s.doc_id) AS n FROM documents d LEFT JOIN spans s USING (doc_id)
    GROUP BY doc_id, d.source) GROUP BY source"""


@query("t08_site_rollup", f"WITH {SPANS_SQL} {ROLLUP_SQL}")
def t08(spark, sf):
    return text.site_rollup(documents(spark, sf), "source", "text", LEXICON)


@query(
    "t09_scoped_rollup",
    f"""WITH {SPANS_SQL}, fresh AS ({ROLLUP_SQL}),
    scope AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
    stale_spans AS (SELECT doc_id, count(*) AS n FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY doc_id ORDER BY s)
        <= 15 THEN 0 ELSE 1 END AS b2 FROM hits WHERE keyword IN ('that', 'with', 'this')) WHERE b2 = 1 GROUP BY doc_id),
    stale AS (SELECT source, count(*) FILTER (n > 0) AS pages_with_hits, count(*) AS total_pages,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS spans, CAST(count(*) FILTER (n > 0) / count(*) AS DECIMAL(6,5)) AS hit_rate
        FROM documents LEFT JOIN stale_spans USING (doc_id) GROUP BY source)
    SELECT * FROM fresh WHERE source IN (FROM scope) UNION ALL SELECT * FROM stale WHERE source NOT IN (FROM scope)""",
)
def t09(spark, sf):
    docs = documents(spark, sf)
    toxic = table(spark, sf, "labels").where("toxic = 1")
    scope = table(spark, sf, "documents").select("doc_id", "source").join(toxic, "doc_id", "left_semi").select("source").distinct()
    stored = text.site_rollup(docs, "source", "text", NARROW_LEXICON)
    fresh = text.site_rollup(join_counted(docs, scope, "source"), "source", "text", LEXICON)
    return scoped_replace(stored, fresh, scope, "source")


LEX_SQL = f"""lex AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '{_W}'), lambda x: lower(x))) AS ws
    FROM documents)"""


@query("t10_full_text_or", f"WITH {LEX_SQL} SELECT doc_id FROM lex WHERE list_has_any(ws, ['whether', 'nicht', 'thereble', 'para'])")
def t10(spark, sf):
    return documents(spark, sf).where(search.any_word(F.col("text"), ["whether", "nicht", "thereble", "para"])).select("doc_id")


@query("t10_full_text_and", f"WITH {LEX_SQL} SELECT doc_id FROM lex WHERE list_has_all(ws, ['that', 'ering', 'with'])")
def t10_and(spark, sf):
    return documents(spark, sf).where(search.all_words(F.col("text"), ["that", "ering", "with"])).select("doc_id")


@query("t10_lexeme_query", f"WITH {LEX_SQL} SELECT doc_id FROM lex WHERE list_has_all(ws, ['thereble', 'of']) OR list_has_any(ws, ['nicht'])")
def t10_lexemes(spark, sf):
    lex = search.lexemes(F.col("text"), stop=())
    wanted = search.matches_all(lex, ["thereble", "of"]) | search.matches_any(lex, ["nicht"])
    return documents(spark, sf).where(wanted).select("doc_id")


@query("t10_stemmed_index")
def t10_stem(spark, sf):
    index = search.stemmed_index(documents(spark, sf), "doc_id", "text")
    return index.groupBy("lexeme").agg(F.count("*").alias("n_docs"))


CENTROID_SQL = """cell AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    mean AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM cell GROUP BY label, i),
    phrase AS (SELECT label AS phrase, list(m / norm ORDER BY i) AS p FROM mean
        JOIN (SELECT label, sqrt(sum(m * m)) AS norm FROM mean GROUP BY label) USING (label) GROUP BY label),
    vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    sims AS (SELECT vec_id, label, phrase, list_dot_product(v, p) AS score FROM vec, phrase),
    best AS (SELECT vec_id, max(score) AS score, CAST(arg_max(phrase, score) AS BIGINT) AS phrase FROM sims GROUP BY vec_id)"""
MEAN_QUERY_SQL = CENTROID_SQL + """,
    qcell AS (SELECT i, avg(x) AS m FROM (SELECT unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM phrase) GROUP BY i),
    q AS (SELECT list(m / (SELECT sqrt(sum(m * m)) FROM qcell) ORDER BY i) AS q FROM qcell),
    qsim AS (SELECT vec_id, label, list_dot_product(v, q) AS score FROM vec, q)"""


def phrases(spark, sf):
    """Query phrases: the mean vector of each label (label, phrase)."""
    centroids = search.mean_vector(table(spark, sf, "embeddings"), "embedding", ["label"])
    return centroids.select(F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("phrase"))


@query("t11_max_similarity", f"WITH {CENTROID_SQL} SELECT vec_id, phrase, round(score, 6) AS score FROM best WHERE score >= 0.25")
def t11(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = search.best_phrase(vectors, "embedding", materialise(phrases(spark, sf), "phrases"), "label", "phrase")
    return scored.where(F.col("score") >= search.MAX_SIM).withColumn("score", F.round("score", 6))


@query("t12_mean_query_similarity", f"WITH {MEAN_QUERY_SQL} SELECT vec_id, round(score, 6) AS score FROM qsim WHERE score >= 0.05")
def t12(spark, sf):
    sim = search.query_similarity(F.col("embedding"), search.mean_query_vector(phrases(spark, sf), "phrase"))
    scored = table(spark, sf, "embeddings").select("vec_id", sim.alias("score")).where(F.col("score") >= 0.05)
    return scored.withColumn("score", F.round("score", 6))


HYBRID_SQL = MEAN_QUERY_SQL + f""", {LEX_SQL},
    flags AS (SELECT doc_id, source, list_has_any(ws, ['thand', 'thin', 'para']) AS lexical,
        coalesce(score >= 0.05, false) AS semantic FROM lex JOIN documents USING (doc_id) LEFT JOIN qsim ON vec_id = doc_id)"""
CELLS_SQL = """SELECT count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only,
    count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either"""


def hybrid_flags(spark, sf):
    sim = search.query_similarity(F.col("embedding"), search.mean_query_vector(phrases(spark, sf), "phrase"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), sim.alias("score"))
    body = F.col("text")
    return (
        documents(spark, sf)
        .select(
            "doc_id",
            "source",
            search.any_word(body, ["thand", "thin", "para"]).alias("lexical"),
            text.has_keyword(body, NARROW_LEXICON).alias("keyword"),
        )
        .join(vectors, "doc_id", "left")
        .withColumn("semantic", F.coalesce(F.col("score") >= 0.05, F.lit(False)))
    )


@query("t13_hybrid_filter", f"WITH {HYBRID_SQL} {CELLS_SQL} FROM (SELECT lexical AS a, semantic AS b FROM flags)")
def t13(spark, sf):
    return search.filter_cells(hybrid_flags(spark, sf), F.col("lexical"), F.col("semantic"))


NARROW_SQL = "list_has_any(ws, ['that', 'with', 'this'])"


@query(
    "t14_filter_comparison",
    f"""WITH {HYBRID_SQL} {CELLS_SQL} FROM (SELECT {NARROW_SQL} AS a, semantic AS b FROM flags JOIN lex USING (doc_id))""",
)
def t14(spark, sf):
    return search.filter_cells(hybrid_flags(spark, sf), F.col("keyword"), F.col("semantic"))


@query(
    "t15_top_missed_pages",
    f"""WITH {CENTROID_SQL}, {LEX_SQL},
    shared AS (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 INTERSECT
        SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT doc_id, phrase, round(score, 6) AS score FROM best JOIN documents ON doc_id = vec_id JOIN lex USING (doc_id)
    WHERE source IN (FROM shared) AND NOT {NARROW_SQL} AND score >= 0.25 ORDER BY best.score DESC, doc_id LIMIT 40""",
)
def t15(spark, sf):
    docs, lab = documents(spark, sf), table(spark, sf, "labels")
    owners = table(spark, sf, "documents").select("doc_id", "source")
    in_list = lambda cond: owners.join(lab.where(cond), "doc_id", "left_semi").select("source")
    overlap = in_list("toxic = 1").intersect(in_list("quality = 1"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    missed = (
        docs.select("doc_id", "source", text.has_keyword(F.col("text"), NARROW_LEXICON).alias("caught"))
        .join(overlap, "source", "left_semi")
        .select("doc_id", "caught")
        .join(search.best_phrase(vectors, "embedding", materialise(phrases(spark, sf), "phrases"), "label", "phrase"), "doc_id")
    )
    top = search.top_missed(missed, "score", "doc_id", F.col("caught"), search.MAX_SIM, 40)
    return top.select("doc_id", "phrase", F.round("score", 6).alias("score"))


@query(
    "t16_budgeted_text",
    """WITH p AS (SELECT doc_id, source, text, least(length(text), 4000) AS len,
        row_number() OVER (PARTITION BY source ORDER BY lang = 'en' DESC, doc_id) AS rn FROM documents WHERE text <> ''),
    u AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY source ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        0) AS used FROM p)
    SELECT source, string_agg(left(text, CAST(least(len, 6000 - used) AS BIGINT)), chr(10) || chr(10) || '---' || chr(10) || chr(10)
        ORDER BY rn) AS agg_text, count(*) AS pages_used FROM u WHERE used < 6000 GROUP BY source""",
)
def t16(spark, sf):
    return text.budgeted_text(documents(spark, sf), "source", "doc_id", "text", (F.col("lang") == "en").cast("int"))


@query(
    "t17_pending_chunks",
    f"""WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, chunk_index FROM chunks WHERE (doc_id + chunk_index) % 3 <> 0""",
)
def t17(spark, sf):
    cut = text.fixed_chunks(documents(spark, sf), "doc_id", "text").drop("chunk_text")
    wanted = materialise(cut, "chunks")  # read twice, cut once
    slot = (F.col("doc_id") + F.col("chunk_index")) % 3
    done = wanted.withColumn("error", F.when(slot == 1, "timeout").when(slot == 0, "")).where(slot < 2)
    return text.pending_work(wanted, done, ["doc_id", "chunk_index"])


@query(
    "t18_keyword_hit_rate",
    f"""WITH {HITS_SQL}, r AS (SELECT keyword, count(*) AS total, count(*) FILTER (quality = 1) AS hits,
        count(*) FILTER (quality = 1) / count(*) AS rate FROM hits JOIN labels USING (doc_id) GROUP BY keyword)
    SELECT keyword, total, hits, round(rate, 6) AS rate, round((SELECT sum(hits) / sum(total) FROM r), 6) AS pooled_rate,
    round((SELECT median(rate) FROM r), 6) AS median_rate FROM r""",
)
def t18(spark, sf):
    hits = text.keyword_occurrences(documents(spark, sf), "doc_id", "text", LEXICON)
    hits = hits.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    rates = text.keyword_hit_rate(hits.withColumn("hit", F.col("quality") == 1), "keyword", "hit")
    return rates.select("keyword", "total", "hits", *[F.round(c, 6).alias(c) for c in ("rate", "pooled_rate", "median_rate")])


def length_scorer(body: str) -> str:
    """Shipped rule scorer: names the size class of a chunk, refuses chunks without a space."""
    if " " not in body:
        raise ValueError("nothing to judge")
    return "long" if len(body) > 400 else "short"


@query(
    "t19_scored_chunks",
    f"""WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, chunk_index, CASE WHEN NOT contains(chunk_text, ' ') THEN NULL
    WHEN length(chunk_text) > 400 THEN 'long' ELSE 'short' END AS label,
    CASE WHEN NOT contains(chunk_text, ' ') THEN 'ValueError: nothing to judge' END AS error FROM chunks""",
)
def t19(spark, sf):
    chunks = text.fixed_chunks(documents(spark, sf), "doc_id", "text")
    return text.score_rows(chunks, "chunk_text", length_scorer, "rule").select("doc_id", "chunk_index", "label", "error")


@query(
    "t20_label_distribution",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL),
    p AS (SELECT source, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS distribution,
        CAST(sum(n) AS BIGINT) AS pages_labelled, string_split(string_agg(lang, ',' ORDER BY n DESC, lang), ',')[1] AS top_label
        FROM c GROUP BY source)
    SELECT source, coalesce(top_label, '') AS top_label, coalesce(distribution, '') AS distribution, pages_labelled
    FROM (SELECT DISTINCT source FROM documents) LEFT JOIN p USING (source)""",
)
def t20(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", "lang")
    labelled = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id")
    return text.label_distribution(docs, labelled, "source", "lang")


@query(
    "t21_candidate_union",
    f"""WITH {HYBRID_SQL} SELECT doc_id FROM flags JOIN lex USING (doc_id) LEFT JOIN labels USING (doc_id)
    WHERE ({NARROW_SQL} OR semantic) AND (quality IS NULL OR toxic = 1)""",
)
def t21(spark, sf):
    flags = hybrid_flags(spark, sf)
    wanted = flags.where(F.col("keyword") | F.col("semantic")).select("doc_id")
    results = table(spark, sf, "labels").withColumn("error", F.when(F.col("toxic") == 1, "rate limited"))
    return text.pending_work(wanted, results, ["doc_id"])
