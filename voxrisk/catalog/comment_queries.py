"""Queries for filters, joins, sentiment, keywords and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrisk import views
from voxrisk.catalog import sqltext as st
from voxrisk.catalog.registry import joined, long, q, query, r6
from voxrisk.functions import text as tx
from voxrisk.functions.lexicon import PROVINCE_EN
from voxrisk.operators import filters, joins, segmentation, sentiment, topics
from voxrisk.operators.bots import bot_features, bot_scores
from voxrisk.operators.regions import coverage
from voxrisk.operators.wordsearch import with_found
from voxrisk.session import settle
from voxrisk.views import LATIN_STOPWORDS, LATIN_V1, LATIN_V2

BY_SOURCE = ["source_file"]


def scored(spark, sf_dir, profile=LATIN_V2):
    rows = views.comments(spark, sf_dir)
    if profile.name == "v2":
        rows = rows.filter(F.col("content") != "")
    return sentiment.with_risk(sentiment.with_sensitive(sentiment.with_sentiment(rows, profile), profile), profile)


# --- filters -------------------------------------------------------------------


@query("filter_nonempty", f"{st.COMMENTS} SELECT ord FROM comments WHERE {st.strip('content')} <> ''")
def filter_nonempty(spark, sf_dir):
    return filters.nonempty(views.comments(spark, sf_dir)).select("ord")


@query("filter_platform_reply", f"{st.COMMENTS} SELECT ord, platform FROM comments WHERE platform IN ('bilibili', 'zhihu') AND is_reply")
def filter_platform_reply(spark, sf_dir):
    return filters.platform_reply(views.comments(spark, sf_dir), ["bilibili", "zhihu"], replies=True).select("ord", "platform")


@query("filter_high_risk", f"{st.SCORED_V2} SELECT ord, CAST(risk_score AS BIGINT) AS risk_score FROM scored2 WHERE risk_score >= 40")
def filter_high_risk(spark, sf_dir):
    return filters.high_risk(scored(spark, sf_dir), 40).select("ord", *long("risk_score"))


@query("filter_min_comments", f"""{st.COMMENTS}
SELECT source_file, {st.USER_KEY} AS "user", count(*) AS n_comments FROM comments GROUP BY 1, 2 HAVING count(*) >= 2""")
def filter_min_comments(spark, sf_dir):
    return filters.users_with_min_comments(views.comments(spark, sf_dir), BY_SOURCE, 2)


@query("filter_valid_time", f"{st.COMMENTS} SELECT ord FROM comments WHERE publish_time IS NOT NULL")
def filter_valid_time(spark, sf_dir):
    return filters.valid_time(views.comments(spark, sf_dir)).select("ord")


_PARTLY = "CASE WHEN ord % 7 < CAST(regexp_extract(source_file, '[0-9]+') AS BIGINT) % 8 THEN ip_location END"


def _partly_located(spark, sf_dir):
    number = F.regexp_extract("source_file", "[0-9]+", 0).cast("bigint")
    rows = views.comments(spark, sf_dir)
    return rows.withColumn("ip_location", F.when(F.col("ord") % 7 < number % 8, F.col("ip_location")))


@query("coverage_gate", f"""{st.COMMENTS}
SELECT source_file, round(CAST(count(ip) AS DOUBLE) / count(*), 6) AS coverage, CAST(count(ip) AS DOUBLE) / count(*) >= 0.3 AS analysed
FROM (SELECT source_file, {_PARTLY} AS ip FROM comments) GROUP BY 1""")
def coverage_gate(spark, sf_dir):
    rows = coverage(_partly_located(spark, sf_dir), BY_SOURCE)
    return rows.select("source_file", *r6("coverage"), (F.col("coverage") >= 0.3).alias("analysed"))


@query("analysis_limit", f"""{st.COMMENTS}
SELECT source_file, ord FROM comments QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY ord) <= 30""")
def analysis_limit(spark, sf_dir):
    return filters.analysis_limit(views.comments(spark, sf_dir), BY_SOURCE, 30).select("source_file", "ord")


@query("analysis_limit_large", f"""{st.ACTIVITY}
SELECT source_file, ord FROM activity QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY ord) <= 1500""")
def analysis_limit_large(spark, sf_dir):
    return filters.analysis_limit(views.activity(spark, sf_dir), BY_SOURCE, 1500).select("source_file", "ord")


@query("preview_limit", f"{st.COMMENTS} SELECT ord, comment_id FROM comments ORDER BY ord LIMIT 1000")
def preview_limit(spark, sf_dir):
    return filters.preview(views.comments(spark, sf_dir)).select("ord", "comment_id")


# --- joins ---------------------------------------------------------------------


@query("join_sentiment_back", f"""{st.SCORED_V2}
SELECT c.comment_id, r.sentiment, round(r.score, 6) AS sentiment_score, CAST(r.risk_score AS BIGINT) AS risk_score
FROM comments c LEFT JOIN (SELECT comment_id, sentiment, score, risk_score FROM scored2 WHERE n_sens > 0) r USING (comment_id)""")
def join_sentiment_back(spark, sf_dir):
    results = scored(spark, sf_dir).filter("sensitive_count > 0")
    twice = results.unionByName(results.withColumns({"ord": F.col("ord") - 1000000000, "sentiment": F.lit("stale")}))
    out = joins.sentiment_back(views.comments(spark, sf_dir), twice)
    return out.select("comment_id", "sentiment", *r6("sentiment_score"), *long("risk_score"))


_SENSITIVE_ROWS = " UNION ALL ".join(
    f"SELECT ord, {q(w)} AS word, {q(c)} AS category FROM comments WHERE contains(content, {q(w)})" for w, c in LATIN_V2.sensitive)


def _word_table(spark):
    return spark.createDataFrame(list(LATIN_V2.sensitive), "word STRING, category STRING")


@query("join_lexicon", f"{st.COMMENTS} {_SENSITIVE_ROWS}")
def join_lexicon(spark, sf_dir):
    return joins.lexicon_join(views.comments(spark, sf_dir), _word_table(spark)).select("ord", "word", "category")


@query("join_lexicon_large", f"{st.COMMENTS} {_SENSITIVE_ROWS}")
def join_lexicon_large(spark, sf_dir):
    return joins.indexed_join(views.comments(spark, sf_dir), _word_table(spark), ["ord"]).select("ord", "word", "category")


# Words of the benchmark items, some thousands of them, as a word list
_ITEM_WORDS = "items AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE length(word) >= 4)"


def _item_words(spark, sf_dir):
    words = views.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return words.where(F.length("word") >= 4).distinct()


@query("join_lexicon_any_size", f"""{st.COMMENTS}, {_ITEM_WORDS}
SELECT ord, word FROM comments JOIN items ON contains(content, word)""")
def join_lexicon_any_size(spark, sf_dir):
    return joins.indexed_join(views.comments(spark, sf_dir), _item_words(spark, sf_dir), ["ord"]).select("ord", "word")


@query("sensitive_detect_any_size", f"""{st.COMMENTS}, {_ITEM_WORDS},
listed AS (SELECT word, CASE WHEN length(word) % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM items)
SELECT ord, CAST(count(word) AS BIGINT) AS sensitive_count, CAST(count(DISTINCT category) AS BIGINT) AS categories, string_agg(word, '|' ORDER BY word) AS words
FROM comments LEFT JOIN listed ON contains(content, word) GROUP BY ord""")
def sensitive_detect_any_size(spark, sf_dir):
    words = _item_words(spark, sf_dir).withColumns({
        "place": F.col("word"), "category": F.when(F.length("word") % 2 == 0, "even").otherwise("odd")})
    found = with_found(views.comments(spark, sf_dir), words, ["source_file", "ord"], "hits")
    count = F.size("hits").cast("bigint")
    return found.select(
        "ord", count.alias("sensitive_count"), F.size(F.array_distinct("hits.category")).cast("bigint").alias("categories"),
        F.when(count > 0, F.array_join("hits.word", "|")).alias("words"))


@query("join_stopwords_anti", f"""{st.COMMENTS}
SELECT ord, token, count(*) AS n FROM (SELECT ord, unnest({st.tokens('content')}) AS token FROM comments)
WHERE token NOT IN ({st.stop(LATIN_STOPWORDS)}) GROUP BY 1, 2""")
def join_stopwords_anti(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in LATIN_STOPWORDS], "word STRING")
    return joins.without_stopwords(topics.token_rows(views.comments(spark, sf_dir), ["ord"], counted=True), words).select("ord", "token", "n")


_ENGLISH = {**PROVINCE_EN, **{f"NATION_{i}": f"Nation {i}" for i in range(0, 25, 2)}}


@query("join_province", f"""{st.COMMENTS}
SELECT ord, ip_location AS region, CASE WHEN ip_location IN ({', '.join(q(f'NATION_{i}') for i in range(0, 25, 2))})
  THEN 'Nation ' || substr(ip_location, 8) ELSE 'Others' END AS english FROM comments""")
def join_province(spark, sf_dir):
    rows = views.comments(spark, sf_dir).select("ord", F.col("ip_location").alias("region"))
    return joins.province_names(rows, joins.province_table(spark, _ENGLISH)).select("ord", "region", "english")


@query("join_parent_reply", """
SELECT c.conv_id, r.turn AS reply_turn, c.role AS parent_user, r.role AS reply_user, CAST(length(c.text) AS BIGINT) AS parent_length
FROM conversations r JOIN conversations c ON r.conv_id = c.conv_id AND c.turn = 0 WHERE r.turn > 0""")
def join_parent_reply(spark, sf_dir):
    talk = views.table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    rows = talk.select(
        (F.col("conv_id") % 8).alias("source_file"), (turn > 0).alias("is_reply"), F.when(turn > 0, conv).alias("parent_id"),
        F.when(turn == 0, conv).otherwise(turn.cast("string")).alias("comment_id"), F.col("role").alias("user_name"),
        F.col("text").alias("content"))
    out = joins.parent_replies(rows)
    return out.select(F.col("parent_id").cast("bigint").alias("conv_id"), F.col("reply_id").cast("bigint").alias("reply_turn"),
                      "parent_user", "reply_user", *long("parent_length"))


@query("semi_high_risk_users", f"""{st.ACTIVITY},
flagged AS (SELECT {st.USER_KEY} AS "user" FROM activity GROUP BY 1 HAVING count(*) >= 3 AND 1 - CAST(count(DISTINCT content) AS DOUBLE) / count(*) > 0.08)
SELECT ord FROM activity WHERE {st.USER_KEY} IN (SELECT "user" FROM flagged)""")
def semi_high_risk_users(spark, sf_dir):
    rows = views.activity(spark, sf_dir)
    accounts = bot_scores(bot_features(rows)).filter(F.col("content_similarity") > 0.08)
    keyed = rows.withColumn("user", F.coalesce(F.nullif("user_id", F.lit("")), F.nullif("user_name", F.lit("")), F.lit("unknown")))
    return joins.comments_of_accounts(keyed, accounts, ["user"]).select("ord")


@query("union_all_sources", f"""{st.COMMENTS},
both_ AS (SELECT platform FROM comments UNION ALL SELECT 'bilibili' FROM events)
SELECT platform, count(*) AS n FROM both_ GROUP BY 1""")
def union_all_sources(spark, sf_dir):
    both = joins.union_all(views.comments(spark, sf_dir), views.activity(spark, sf_dir))
    return both.groupBy("platform").agg(F.count("*").alias("n"))


# --- sentiment and row risk ----------------------------------------------------


@query("sentiment_lexicon_v2", f"""{st.SCORED_V2}
SELECT ord, sentiment, round(score, 6) AS sentiment_score, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM scored2""")
def sentiment_lexicon_v2(spark, sf_dir):
    rows = filters.nonempty(views.comments(spark, sf_dir))
    return sentiment.with_sentiment(rows, LATIN_V2).select("ord", "sentiment", *r6("sentiment_score", "confidence"))


@query("sentiment_lexicon_v1", f"{st.SCORED_V1} SELECT ord, sentiment, round(score, 6) AS sentiment_score FROM scored1")
def sentiment_lexicon_v1(spark, sf_dir):
    return sentiment.with_sentiment(views.comments(spark, sf_dir), LATIN_V1).select("ord", "sentiment", *r6("sentiment_score"))


@query("sensitive_detect", f"""{st.SCORED_V2}
SELECT ord, CAST(n_sens AS BIGINT) AS sensitive_count, CAST(n_cat AS BIGINT) AS n_categories,
  array_to_string(list_filter([{', '.join(q(w) for w, _ in LATIN_V2.sensitive)}], lambda w: contains(content, w)), '|') AS words FROM scored2""")
def sensitive_detect(spark, sf_dir):
    rows = sentiment.with_sensitive(views.comments(spark, sf_dir), LATIN_V2)
    words = F.array_join(F.transform("sensitive_words", lambda x: x["word"]), "|")
    return rows.select("ord", *long("sensitive_count"), F.size("sensitive_categories").cast("bigint").alias("n_categories"), words.alias("words"))


@query("sensitive_detect_v1", f"""{st.SCORED_V1}
SELECT ord, CAST(n_sens AS BIGINT) AS sensitive_count,
  array_to_string(list_filter([{', '.join(q(w) for w, _ in LATIN_V1.sensitive)}], lambda w: contains(content, w)), '|') AS sensitive_words FROM scored1""")
def sensitive_detect_v1(spark, sf_dir):
    rows = sentiment.with_sensitive(views.comments(spark, sf_dir), LATIN_V1)
    return rows.select("ord", *long("sensitive_count"), joined("sensitive_words"))


@query("row_risk_v2", f"""{st.SCORED_V2}
SELECT ord, CAST(p_sent AS BIGINT) AS sentiment_points, CAST(p_sens AS BIGINT) AS sensitive_points, CAST(p_text AS BIGINT) AS text_points,
  CAST(risk_score AS BIGINT) AS risk_score, risk_level FROM scored2""")
def row_risk_v2(spark, sf_dir):
    f = "risk_factors"
    return scored(spark, sf_dir).select(
        "ord", F.col(f"{f}.sentiment").cast("bigint").alias("sentiment_points"), F.col(f"{f}.sensitive").cast("bigint").alias("sensitive_points"),
        F.col(f"{f}.text_features").cast("bigint").alias("text_points"), *long("risk_score"), "risk_level")


@query("row_risk_v1", f"{st.SCORED_V1} SELECT ord, CAST(risk_score AS BIGINT) AS risk_score, risk_level FROM scored1")
def row_risk_v1(spark, sf_dir):
    return scored(spark, sf_dir, LATIN_V1).select("ord", *long("risk_score"), "risk_level")


def _share(name: str) -> str:
    return f"round(CAST({name} AS DOUBLE) / total, 6) AS {name}_ratio"


DISTRIBUTION_V2 = """SELECT source_file, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral,
  count(*) FILTER (n_sens > 0) AS with_sensitive, count(*) FILTER (risk_score >= {high}) AS high_risk,
  avg(score) AS avg_sentiment_score, avg(risk_score) AS avg_risk_score FROM scored2 GROUP BY 1"""


@query("sentiment_distribution_v2", f"""{st.SCORED_V2}
SELECT source_file, total, positive, negative, neutral, with_sensitive, high_risk, round(avg_sentiment_score, 6) AS avg_sentiment_score,
  round(avg_risk_score, 6) AS avg_risk_score, {_share('positive')}, {_share('negative')}, {_share('neutral')}, {_share('with_sensitive')}, {_share('high_risk')}
FROM ({DISTRIBUTION_V2.format(high=40)})""")
def sentiment_distribution_v2(spark, sf_dir):
    names = ("positive", "negative", "neutral", "with_sensitive", "high_risk")
    out = sentiment.distribution(scored(spark, sf_dir), BY_SOURCE, "v2", high_risk=40)
    return out.select("source_file", "total", *names, *r6("avg_sentiment_score", "avg_risk_score", *[f"{n}_ratio" for n in names]))


@query("sentiment_distribution_v1", f"""{st.SCORED_V1}
SELECT source_file, total, positive, negative, neutral, round(avg_score, 6) AS avg_sentiment_score, round(avg_risk, 6) AS avg_risk_score,
  {_share('positive')}, {_share('negative')}, {_share('neutral')}
FROM (SELECT source_file, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
  count(*) FILTER (sentiment = 'neutral') AS neutral, avg(score) AS avg_score, avg(risk_score) AS avg_risk FROM scored1 GROUP BY 1)""")
def sentiment_distribution_v1(spark, sf_dir):
    names = ("positive", "negative", "neutral")
    out = sentiment.distribution(scored(spark, sf_dir, LATIN_V1), BY_SOURCE, "v1")
    return out.select("source_file", "total", *names, *r6("avg_sentiment_score", "avg_risk_score", *[f"{n}_ratio" for n in names]))


@query("sensitive_category_counts", f"""{st.COMMENTS}
SELECT category, count(DISTINCT ord) AS n FROM ({_SENSITIVE_ROWS}) GROUP BY 1""")
def sensitive_category_counts(spark, sf_dir):
    return sentiment.category_counts(sentiment.with_sensitive(views.comments(spark, sf_dir), LATIN_V2))


def _bins(column: str, bins: int, high: int) -> str:
    width = high / bins
    return f"""SELECT CAST(b AS BIGINT) AS bin, CAST(round(b * {width}, 6) AS DOUBLE) AS bin_low, count(s.ord) AS n FROM range({bins}) t(b)
LEFT JOIN scored2 s ON least(CAST(floor(s.{column} / {width}) AS BIGINT), {bins - 1}) = b GROUP BY b"""


@query("risk_histogram", f"{st.SCORED_V2} {_bins('risk_score', 20, 100)}")
def risk_histogram(spark, sf_dir):
    out = sentiment.histogram(scored(spark, sf_dir), "risk_score", 20, 0.0, 100.0)
    return out.select(*long("bin"), *r6("bin_low"), "n")


@query("sentiment_histogram", f"{st.SCORED_V2} {_bins('score', 25, 1)}")
def sentiment_histogram(spark, sf_dir):
    out = sentiment.histogram(scored(spark, sf_dir), "sentiment_score", 25, 0.0, 1.0)
    return out.select(*long("bin"), *r6("bin_low"), "n")


@query("top_high_risk", f"""{st.SCORED_V2}
SELECT source_file, ord, substr(content, 1, 100) AS content, CAST(risk_score AS BIGINT) AS risk_score,
  row_number() OVER (PARTITION BY source_file ORDER BY risk_score DESC, ord) AS rank
FROM scored2 WHERE risk_score >= 20 QUALIFY rank <= 10""")
def top_high_risk(spark, sf_dir):
    top = sentiment.top_high_risk(scored(spark, sf_dir), BY_SOURCE, threshold=20, k=10)
    return top.select("source_file", "ord", "content", *long("risk_score", "rank"))


# --- tokens, keywords, topics --------------------------------------------------


@query("tokenize_split", f"""{st.COMMENTS}
SELECT ord, token, count(*) AS n FROM (SELECT ord, unnest({st.tokens('content')}) AS token FROM comments)
WHERE token NOT IN ({st.stop(LATIN_STOPWORDS)}) GROUP BY 1, 2""")
def tokenize_split(spark, sf_dir):
    return topics.token_rows(views.comments(spark, sf_dir), ["ord"], LATIN_STOPWORDS, counted=True)


_CHARS = "'天气很好今天'"


@query("tokenize_cjk", f"""
SELECT doc_id, token, count(*) AS n FROM (
  SELECT doc_id, unnest(list_concat(
    list_filter(list_transform(range(1, 6), lambda i: substr({_CHARS}, i, 2)), lambda w: length(w) = 2),
    list_filter(regexp_extract_all(text, {q(tx.LATIN_RUN)}), lambda w: length(w) > 1))) AS token
  FROM documents) GROUP BY 1, 2""")
def tokenize_cjk(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" 天气很好今天")).alias("content"))
    return topics.token_rows(docs, ["doc_id"], cjk=True).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


# The given texts are in Latin letters; each run of letters is taken as one without spaces, and the words found are its building blocks
_LETTERS = r"[\p{L}]+"


@query("find_words", f"""
WITH runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_LETTERS}')) AS run FROM documents) GROUP BY run),
grams AS (
  SELECT gram, length(gram) AS size, sum(n) AS n FROM (
    SELECT substr('^' || run || '^', i, k) AS gram, n FROM runs, range(1, 6) s(k), unnest(range(1, length(run) + 4 - k)) t(i)) GROUP BY gram),
inside AS (SELECT * FROM grams WHERE NOT contains(gram, '^')),
total AS (SELECT sum(n) AS total FROM inside WHERE size = 1),
held AS (
  SELECT g.gram AS word, g.n FROM inside g, unnest(range(1, g.size)) t(k)
  JOIN inside l ON l.gram = substr(g.gram, 1, k) JOIN inside r ON r.gram = substr(g.gram, k + 1)
  WHERE g.size BETWEEN 2 AND 4 AND g.n >= 5 GROUP BY g.gram, g.n HAVING min(g.n / (CAST(l.n AS DOUBLE) * r.n / (SELECT total FROM total))) >= 20),
before AS (SELECT substr(gram, 2) AS word, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM grams WHERE size > 2 GROUP BY 1),
behind AS (SELECT substr(gram, 1, size - 1) AS word, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM grams WHERE size > 2 GROUP BY 1)
SELECT word, CAST(n AS BIGINT) AS n, round(ln(n / total), 6) AS weight FROM (
  SELECT h.word, h.n FROM held h JOIN before b USING (word) JOIN behind e USING (word) WHERE least(b.h, e.h) >= 0.8
  UNION ALL SELECT gram, n FROM inside WHERE size = 1), total""")
def find_words(spark, sf_dir):
    found = settle(segmentation.runs(views.table(spark, sf_dir, "documents"), "text", _LETTERS), "runs")
    return segmentation.find_words(found).select("word", "n", *r6("weight"))


@query("segment_words")
def segment_words(spark, sf_dir):
    return segmentation.segment(views.table(spark, sf_dir, "documents"), ["doc_id"], "text", _LETTERS)


_TOKENS = f"""tok AS (SELECT * FROM (SELECT source_file, ord, like_count, unnest({st.tokens('content')}) AS token FROM comments)
  WHERE token NOT IN ({st.stop(LATIN_STOPWORDS)}))"""
_PER_ROW = f"""{_TOKENS},
tf AS (SELECT ord, token, count(*) AS tf FROM tok GROUP BY 1, 2),
idf AS (SELECT token, ln((SELECT count(*) FROM comments)::DOUBLE / count(*)) AS idf FROM tf GROUP BY 1)"""


@query("keywords_per_row", f"""{st.COMMENTS}, {_PER_ROW}
SELECT ord, string_agg(token, '|' ORDER BY rn) AS keywords FROM (
  SELECT ord, token, row_number() OVER (PARTITION BY ord ORDER BY round(tf * idf, 9) DESC, token) AS rn FROM tf JOIN idf USING (token))
WHERE rn <= 10 GROUP BY 1""")
def keywords_per_row(spark, sf_dir):
    return topics.keywords_per_row(views.comments(spark, sf_dir), LATIN_STOPWORDS).select("ord", joined("keywords"))


@query("keywords_first10", f"""{st.COMMENTS}
SELECT ord, array_to_string(list_filter({st.tokens('content')}, lambda w: NOT list_contains([{st.stop(LATIN_STOPWORDS)}], w))[1:10], '|') AS keywords FROM comments""")
def keywords_first10(spark, sf_dir):
    return views.comments(spark, sf_dir).select("ord", F.array_join(tx.first_keywords(F.col("content"), LATIN_STOPWORDS), "|").alias("keywords"))


@query("keywords_tfidf", f"""{st.COMMENTS}, {_TOKENS},
tf AS (SELECT source_file, token, count(*) AS tf FROM tok GROUP BY 1, 2),
tot AS (SELECT source_file, sum(tf) AS tokens FROM tf GROUP BY 1),
dfs AS (SELECT token, count(DISTINCT ord) AS df FROM tok GROUP BY 1)
SELECT source_file, token, CAST(tf AS BIGINT) AS tf, df, round(w, 6) AS weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY w DESC, token) AS rank FROM (
    SELECT source_file, token, tf, df, round(CAST(tf AS DOUBLE) / tokens * ln((SELECT count(*) FROM comments)::DOUBLE / df), 9) AS w
    FROM tf JOIN tot USING (source_file) JOIN dfs USING (token))) WHERE rank <= 20""")
def keywords_tfidf(spark, sf_dir):
    top = topics.keywords_tfidf(views.comments(spark, sf_dir), BY_SOURCE, LATIN_STOPWORDS, 20)
    return top.select("source_file", "token", "tf", "df", *r6("weight"), *long("rank"))


@query("keywords_count", f"""{st.COMMENTS}, {_TOKENS}
SELECT source_file, token, n, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, token) AS rank
FROM (SELECT source_file, token, count(*) AS n FROM tok GROUP BY 1, 2) QUALIFY rank <= 20""")
def keywords_count(spark, sf_dir):
    top = topics.keywords_count(views.comments(spark, sf_dir), BY_SOURCE, LATIN_STOPWORDS)
    return top.select("source_file", "token", "n", *long("rank"))


@query("weighted_word_freq", rf"""{st.COMMENTS}, {_TOKENS}
SELECT token, w AS weight, row_number() OVER (ORDER BY w DESC, token) AS rank FROM (
  SELECT token, round(sum(1 + ln(1 + like_count)), 6) AS w FROM tok WHERE NOT regexp_matches(token, '^\p{{N}}+$') GROUP BY 1)
QUALIFY rank <= 100""")
def weighted_word_freq(spark, sf_dir):
    top = topics.weighted_word_freq(views.comments(spark, sf_dir), [], LATIN_STOPWORDS)
    return top.select("token", "weight", *long("rank"))


_TOP_KW = """kw AS (SELECT source_file, token, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, token) AS rank
  FROM (SELECT source_file, token, count(*) AS n FROM tok GROUP BY 1, 2) QUALIFY rank <= 10),
kws AS (SELECT source_file, list(token ORDER BY rank) AS kw FROM kw GROUP BY 1),
lab AS (SELECT source_file, ord, CASE WHEN len(h) = 0 THEN '其他' ELSE array_to_string(list_sort(h[1:3]), '+') END AS topic
  FROM (SELECT source_file, ord, list_filter(kw, lambda w: contains(content, w)) AS h FROM comments JOIN kws USING (source_file))),
clusters AS (SELECT source_file, topic, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, first) AS rank FROM (
    SELECT source_file, topic, count(*) AS n, min(ord) AS first FROM lab GROUP BY 1, 2)) WHERE rank <= 10)"""


@query("topic_clusters", f"""{st.COMMENTS}, {_TOKENS}, {_TOP_KW}
SELECT source_file, topic, n, rank, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source_file), 6) AS ratio FROM clusters""")
def topic_clusters(spark, sf_dir):
    rows = views.comments(spark, sf_dir)
    words = topics.keywords_count(rows, BY_SOURCE, LATIN_STOPWORDS)
    out = topics.topic_clusters(rows, BY_SOURCE, words)
    return out.select("source_file", "topic", "n", *long("rank"), *r6("ratio"))


_ORIENT = """CASE WHEN p > 0.6 THEN 'strongly_positive' WHEN p > 0.4 THEN 'positive' WHEN g > 0.6 THEN 'strongly_negative'
  WHEN g > 0.4 THEN 'negative' ELSE 'neutral' END"""
_LEAN = f"""lean AS (SELECT source_file, total, {_ORIENT} AS orientation FROM (
  SELECT source_file, count(*) AS total, CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(*) AS p,
    CAST(count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(*) AS g FROM scored1 GROUP BY 1))"""


@query("sentiment_orientation", f"""{st.SCORED_V1}, {_LEAN}
SELECT source_file, orientation, CASE orientation WHEN 'strongly_positive' THEN '强烈支持' WHEN 'positive' THEN '偏向支持'
  WHEN 'strongly_negative' THEN '强烈反对' WHEN 'negative' THEN '偏向反对' ELSE '中立' END AS orientation_label FROM lean""")
def sentiment_orientation(spark, sf_dir):
    mood = sentiment.distribution(scored(spark, sf_dir, LATIN_V1), BY_SOURCE, "v1")
    return topics.orientation(mood).select("source_file", "orientation", "orientation_label")


_SENS_KW = " UNION ALL ".join(
    f"SELECT source_file, {q(w)} AS word, count(*) AS n FROM comments WHERE contains(content, {q(w)}) GROUP BY 1" for w in LATIN_V1.topic_sensitive)


@query("sensitive_keyword_counts", f"""{st.COMMENTS}
SELECT source_file, word, n, CASE WHEN n > 50 THEN 'high' WHEN n > 20 THEN 'medium' ELSE 'low' END AS level,
  row_number() OVER (PARTITION BY source_file ORDER BY n DESC, word) AS rank FROM ({_SENS_KW}) QUALIFY rank <= 10""")
def sensitive_keyword_counts(spark, sf_dir):
    out = topics.sensitive_keyword_counts(views.comments(spark, sf_dir), BY_SOURCE, LATIN_V1.topic_sensitive)
    return out.select("source_file", "word", "n", "level", *long("rank"))


_TREND = """CASE WHEN total > 10000 THEN 40 WHEN total > 5000 THEN 35 WHEN total > 1000 THEN 30 WHEN total > 500 THEN 25
    WHEN total > 100 THEN 20 ELSE least(total / 5.0, 20) END + least(weight * 10, 30)
  + CASE WHEN orientation LIKE 'strongly%' THEN 30 WHEN orientation IN ('positive', 'negative') THEN 20 ELSE 10 END"""
TOPIC_CTES = f"""{_LEAN}, {_TOKENS}, {_TOP_KW},
wt AS (SELECT source_file, sum(n) AS weight FROM (SELECT source_file, token, count(*) AS n,
  row_number() OVER (PARTITION BY source_file ORDER BY count(*) DESC, token) AS rk FROM tok GROUP BY 1, 2) WHERE rk <= 10 GROUP BY 1),
tr AS (SELECT source_file, total, orientation, CAST(least({_TREND}, 100) AS DOUBLE) AS score FROM lean JOIN wt USING (source_file))"""
_TREND_SQL = f"{st.SCORED_V1}, {TOPIC_CTES}"
TREND_LEVEL = "CASE WHEN score >= 80 THEN '极热' WHEN score >= 60 THEN '热门' WHEN score >= 40 THEN '一般' ELSE '冷门' END"


def _topic_summary(spark, sf_dir):
    rows = views.comments(spark, sf_dir)
    words = topics.keywords_count(rows, BY_SOURCE, LATIN_STOPWORDS)
    leaning = topics.orientation(sentiment.distribution(scored(spark, sf_dir, LATIN_V1), BY_SOURCE, "v1"))
    risky = topics.sensitive_keyword_counts(rows, BY_SOURCE, LATIN_V1.topic_sensitive)
    return topics.topic_summary(words, topics.topic_clusters(rows, BY_SOURCE, words), risky, leaning, BY_SOURCE, weight="n")


@query("trending_score", f"{_TREND_SQL} SELECT source_file, round(score, 6) AS trending_score, {TREND_LEVEL} AS trending_level FROM tr")
def trending_score(spark, sf_dir):
    rows = views.comments(spark, sf_dir)
    words = topics.keywords_count(rows, BY_SOURCE, LATIN_STOPWORDS, 10)
    weight = words.groupBy("source_file").agg(F.sum("n").cast("double").alias("w"))
    leaning = topics.orientation(sentiment.distribution(scored(spark, sf_dir, LATIN_V1), BY_SOURCE, "v1"))
    out = leaning.join(weight, "source_file", "left")
    out = out.withColumn("trending_score", topics.trending_score(F.col("total"), F.col("w"), F.col("orientation")))
    return out.select("source_file", *r6("trending_score"), topics.trending_level(F.col("trending_score")).alias("trending_level"))


@query("topic_summary", f"""{_TREND_SQL}
SELECT source_file, round(score, 6) AS trending_score, {TREND_LEVEL} AS trending_level, orientation,
  (SELECT string_agg(token, '|' ORDER BY rank) FROM kw WHERE kw.source_file = tr.source_file AND rank <= 5) AS top_5_keywords,
  (SELECT count(*) FROM clusters k WHERE k.source_file = tr.source_file) AS topic_clusters_count,
  (SELECT count(*) FROM ({_SENS_KW}) k WHERE k.source_file = tr.source_file) AS sensitive_keywords_count
FROM tr""")
def topic_summary(spark, sf_dir):
    return _topic_summary(spark, sf_dir).select(
        "source_file", *r6("trending_score"), "trending_level", "orientation", joined("top_5_keywords"),
        "topic_clusters_count", "sensitive_keywords_count")
