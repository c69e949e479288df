"""Keywords, topic labels, orientation and trend score (v1), word weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.functions import scoring as sc
from voxrisk.functions import text as tx
from voxrisk.operators.scaling import keyed, top_k, unkeyed
from voxrisk.session import cut_lineage

OTHER_TOPIC = "其他"


def _keep(word: Column, stopwords: Sequence[str]) -> Column:
    return ~word.isin(*stopwords) if stopwords else F.lit(True)


def token_rows(df: DataFrame, keep: Sequence[str], stopwords: Sequence[str] = (), cjk: bool = False, counted: bool = False) -> DataFrame:
    """One row per token occurrence. ``counted``: one row per different token of the texts with equal ``keep``, with ``n``; the tokens of
    a text are counted within it, so ``keep`` should tell the rows apart, and no task holds more than their texts."""
    if counted:
        texts = df.groupBy(*keep).agg(F.array_join(F.collect_list("content"), " ").alias("content"))
        return _counted_tokens(texts, keep, cjk).filter(F.col("token").isNotNull() & _keep(F.col("token"), stopwords))
    content = F.col("content")
    words = tx.cjk_tokens(content) if cjk else tx.tokens(content)
    # outer: a plain explode would split every text once more to test for emptiness
    rows = df.select(*keep, F.explode_outer(words).alias("token"))
    return rows.filter(F.col("token").isNotNull() & _keep(F.col("token"), stopwords))


def _counted_tokens(texts: DataFrame, keep: Sequence[str], cjk: bool) -> DataFrame:
    """(keep, token, n) per text: its tokens are sorted, and the places where a new one begins tell how often each stands."""
    words = tx.cjk_tokens(F.col("content")) if cjk else tx.tokens(F.col("content"))
    rows = sc.computed_once(texts.select(*keep, "content"), _words=F.sort_array(words)).select(*keep, "_words")
    size = F.size("_words")
    new = lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1))
    rows = sc.computed_once(rows, _begins=F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), new)))
    count = lambda i, k: F.coalesce(F.get("_begins", k + 1), size) - i
    found = F.transform("_begins", lambda i, k: F.struct(F.get("_words", i).alias("token"), count(i, k).cast("bigint").alias("n")))
    return rows.select(*keep, F.inline_outer(found))


def keywords_count(df: DataFrame, scope: Sequence[str], stopwords: Sequence[str], k: int = 20) -> DataFrame:
    """Most frequent tokens; equal counts in token order."""
    counts = token_rows(df, scope, stopwords).groupBy(*scope, "token").agg(F.count("*").alias("n"))
    return top_k(counts, scope, [F.desc("n"), F.col("token")], k, spread_on=["token"])


def corpus_counts(df: DataFrame, scope: Sequence[str], stopwords: Sequence[str]) -> DataFrame:
    """Occurrences (tf) and containing rows (df) of every token, in one shuffle.

    A row sends each token once per occurrence and once for itself; both are summed
    on the map side before anything is moved.
    """
    rows = sc.computed_once(df.select(*scope, "content"), _words=tx.tokens(F.col("content")))
    words = F.col("_words")
    occurrence = F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    presence = F.transform(
        F.array_distinct(words), lambda w: F.struct(w.alias("token"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    )
    rows = rows.select(*scope, F.inline_outer(F.concat(occurrence, presence)))
    rows = rows.filter(F.col("token").isNotNull() & _keep(F.col("token"), stopwords))
    return rows.groupBy(*scope, "token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def keywords_tfidf(df: DataFrame, scope: Sequence[str], stopwords: Sequence[str], k: int = 20) -> DataFrame:
    """Top tokens by tf * ln(docs / df), the idf taken over the whole table.

    Inside a scope the share tf / total tokens is weighted.
    """
    counts = cut_lineage(corpus_counts(df, scope, stopwords))  # read three times below, the text once
    docs = df.agg(F.count("*").alias("docs")).scalar()
    if scope:
        corpus = counts.groupBy("token").agg(F.sum("df").alias("_df"))
        totals = counts.groupBy(*scope).agg(F.sum("tf").alias("_tokens"))
        joined = counts.join(corpus, "token").join(totals, list(scope))
        tokens = F.col("_tokens")
    else:
        joined = counts.withColumn("_df", F.col("df"))
        tokens = counts.agg(F.sum("tf").alias("tokens")).scalar()
    weight = F.round(F.col("tf") / tokens * F.ln(docs / F.col("_df")), 9)
    scored = joined.select(*scope, "token", "tf", F.col("_df").alias("df"), weight.alias("weight"))
    return top_k(scored, scope, [F.desc("weight"), F.col("token")], k, spread_on=["token"])


def keywords_per_row(df: DataFrame, stopwords: Sequence[str], k: int = 10) -> DataFrame:
    """Ten best tokens of every comment, known by (source_file, ord), by tf * ln(docs / df)."""
    row = ["source_file", "ord"]
    per_row = token_rows(df, row, stopwords, counted=True).withColumnRenamed("n", "tf")
    present = df.select(F.explode_outer(F.array_distinct(tx.tokens(F.col("content")))).alias("token"))
    corpus = present.filter(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("_df"))
    docs = df.agg(F.count("*").alias("docs")).scalar()
    weight = F.round(F.col("tf") * F.ln(docs / F.col("_df")), 9)
    scored = per_row.join(corpus, "token").select(*row, "token", weight.alias("weight"))
    best = top_k(scored, row, [F.desc("weight"), F.col("token")], k)
    packed = F.array_sort(F.collect_list(F.struct("rank", "token")))  # at most k entries
    return best.groupBy(*row).agg(F.transform(packed, lambda x: x["token"]).alias("keywords"))


def weighted_word_freq(
    df: DataFrame, scope: Sequence[str], stopwords: Sequence[str], k: int = 100, weighted: bool = True
) -> DataFrame:
    """Words weighted by 1 + ln(1 + likes) per occurrence, digits-only words left out."""
    likes = F.coalesce("like_count", F.lit(0))
    weight = 1 + F.log1p(likes) if weighted else F.lit(1.0)
    rows = df.withColumn("_w", weight)
    words = token_rows(rows, [*scope, "_w"], stopwords).filter(~F.col("token").rlike(r"^\p{N}+$"))
    sums = words.groupBy(*scope, "token").agg(F.round(F.sum("_w"), 6).alias("weight"))
    return top_k(sums, scope, [F.desc("weight"), F.col("token")], k, spread_on=["token"])


def topic_clusters(df: DataFrame, scope: Sequence[str], keywords: DataFrame, first: int = 10, k: int = 10) -> DataFrame:
    """Rows per topic label. A label joins up to three of the scope's leading
    keywords found in the row; rows without any are counted as other."""
    leading = keywords.filter(F.col("rank") <= first).groupBy(*scope).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("_kw")
    )
    rows = df.select(*scope, "content", "ord")
    joined = rows.join(leading, list(scope), "left") if scope else rows.withColumn("_kw", leading.scalar())
    hits = F.filter(F.coalesce("_kw", F.array().cast("array<string>")), lambda w: F.contains(F.col("content"), w))
    named = joined.select(*scope, "ord", hits.alias("_hits"))
    label = F.when(
        F.size("_hits") == 0, F.lit(OTHER_TOPIC)
    ).otherwise(F.array_join(F.array_sort(F.slice("_hits", 1, 3)), "+"))
    counts = named.groupBy(*scope, label.alias("topic")).agg(F.count("*").alias("n"), F.min("ord").alias("_first"))
    top = top_k(counts, scope, [F.desc("n"), F.col("_first")], k).drop("_first")
    keys = list(scope) or [F.lit(0)]
    total = F.sum("n").over(Window.partitionBy(*keys))
    return top.withColumn("ratio", F.try_divide("n", total))


def orientation(distribution: DataFrame) -> DataFrame:
    """Leaning of a scope from its sentiment ratios."""
    pos, neg = F.col("positive_ratio"), F.col("negative_ratio")
    rules = [
        (pos > 0.6, "strongly_positive", "强烈支持"),
        (pos > 0.4, "positive", "偏向支持"),
        (neg > 0.6, "strongly_negative", "强烈反对"),
        (neg > 0.4, "negative", "偏向反对"),
    ]
    name, label = F.lit("neutral"), F.lit("中立")
    for test, key, text in reversed(rules):
        name, label = F.when(test, key).otherwise(name), F.when(test, text).otherwise(label)
    return distribution.withColumns({"orientation": name, "orientation_label": label})


def sensitive_keyword_counts(df: DataFrame, scope: Sequence[str], words: Sequence[str], k: int = 10) -> DataFrame:
    """Rows containing each word, the ``k`` most frequent, with a level."""
    return word_ranking(df.select(*scope, sc.contained_words(F.col("content"), words).alias("_words")), scope, "_words", k)


def word_ranking(df: DataFrame, scope: Sequence[str], words: str, k: int = 10) -> DataFrame:
    """The most frequent words of an array column, with a level."""
    hits = df.select(*scope, F.explode_outer(words).alias("word")).filter(F.col("word").isNotNull())
    counts = hits.groupBy(*scope, "word").agg(F.count("*").alias("n"))
    top = top_k(counts, scope, [F.desc("n"), F.col("word")], k)
    return top.withColumn("level", F.when(F.col("n") > 50, "high").when(F.col("n") > 20, "medium").otherwise("low"))


def trending_score(total: Column, top_weight: Column, leaning: Column) -> Column:
    """0-100 from volume, summed weight of the ten leading keywords and leaning
    (null leaning: no sentiment known)."""
    volume = (
        F.when(total > 10000, 40.0).when(total > 5000, 35.0).when(total > 1000, 30.0)
        .when(total > 500, 25.0).when(total > 100, 20.0).otherwise(F.least(total / 5, F.lit(20.0)))
    )
    heat = F.least(F.coalesce(top_weight, F.lit(0.0)) * 10, F.lit(30.0))
    strength = (
        F.when(leaning.isNull(), 0.0)
        .when(leaning.isin("strongly_positive", "strongly_negative"), 30.0)
        .when(leaning.isin("positive", "negative"), 20.0)
        .otherwise(10.0)
    )
    return F.least(volume + heat + strength, F.lit(100.0))


def trending_level(score: Column) -> Column:
    return F.when(score >= 80, "极热").when(score >= 60, "热门").when(score >= 40, "一般").otherwise("冷门")


def topic_summary(
    keywords: DataFrame, clusters: DataFrame, sensitive: DataFrame, leaning: DataFrame, scope: Sequence[str] = (),
    weight: str = "weight",
) -> DataFrame:
    """One row per scope. ``leaning`` needs ``total``, ``orientation`` and
    ``orientation_label``; the other inputs are the top-k tables."""
    keys, base = keyed(leaning, scope)
    packed = F.array_sort(F.collect_list(F.struct("rank", "token")))
    words = keyed(keywords, scope)[1].groupBy(*keys).agg(
        F.count("*").alias("top_keywords_count"),
        F.sum(F.when(F.col("rank") <= 10, F.col(weight)).cast("double")).alias("top_weight"),
        F.transform(F.slice(packed, 1, 10), lambda x: x["token"]).alias("top_keywords"),
    )
    topics = keyed(clusters, scope)[1].groupBy(*keys).agg(F.count("*").alias("topic_clusters_count"))
    risky = keyed(sensitive, scope)[1].groupBy(*keys).agg(F.count("*").alias("sensitive_keywords_count"))
    base = base.select(*keys, "total", "orientation", "orientation_label")
    joined = base.join(words, keys, "left").join(topics, keys, "left").join(risky, keys, "left")
    counts = ("top_keywords_count", "topic_clusters_count", "sensitive_keywords_count")
    out = joined.withColumns({
        **{name: F.coalesce(name, F.lit(0)) for name in counts},
        "top_5_keywords": F.coalesce(F.slice("top_keywords", 1, 5), F.array().cast("array<string>")),
        "trending_score": trending_score(F.col("total"), F.col("top_weight"), F.col("orientation")),
    })
    out = out.withColumns({
        "has_sensitive": F.col("sensitive_keywords_count") > 0,
        "trending_level": trending_level(F.col("trending_score")),
    })
    return unkeyed(out, scope)
