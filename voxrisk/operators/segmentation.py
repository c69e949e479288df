"""Words of scripts without spaces: found in the corpus by their own statistics, then the best split of every run of characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.session import settle

#: Fixed value: runs of Chinese, Japanese and Korean characters.
RUNS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+"
MOST_LETTERS, LEAST_COUNT, LEAST_COHESION, LEAST_ENTROPY = 4, 5, 20.0, 0.8
UNKNOWN = -1000.0  # weight of a character that no list holds
EDGE = "\x00"  # stands on both sides of a run; no text holds it within a run


def runs(df: DataFrame, content: str = "content", pattern: str = RUNS) -> DataFrame:
    """(run, n): every different run of characters of the script, and how often it stands in the texts. All later work is done once per
    different run, so copies of texts cost nothing."""
    found = df.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(f"({pattern})"), F.lit(1))).alias("run"))
    return found.groupBy("run").agg(F.count("*").alias("n"))


def gram_counts(found: DataFrame, letters: int) -> DataFrame:
    """(gram, n) of all grams of 1 to ``letters`` characters of the runs, with EDGE around each run as a character."""
    framed = F.concat(F.lit(EDGE), F.col("run"), F.lit(EDGE))
    grams = F.flatten(F.array(*[F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in range(1, letters + 1)]))
    return found.select(F.explode(grams).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def find_words(
    found: DataFrame, most_letters: int = MOST_LETTERS, least_count: int = LEAST_COUNT, least_cohesion: float = LEAST_COHESION, least_entropy: float = LEAST_ENTROPY,
) -> DataFrame:
    """(word, n, weight) of the words in runs (run, n), and of all single characters.

    A gram of two characters and more is a word if it occurs ``least_count`` times; if it holds together: for its worst cut into two parts its
    count is ``least_cohesion`` times what chance would give; and if its surroundings vary: the entropies of the characters
    before and behind it, an edge being one of them, are both at least ``least_entropy`` (natural logarithm). The weight is the logarithm of
    its share of all characters. Everything follows from gram counts, which tasks sum first; no text is moved."""
    grams = settle(gram_counts(found, most_letters + 1).withColumn("size", F.length("gram")), "grams")
    inner = grams.where(~F.contains("gram", F.lit(EDGE)))
    total = inner.where("size = 1").agg(F.sum("n")).first()[0] or 1
    listed = inner.where((F.col("size") > 1) & (F.col("size") <= most_letters) & (F.col("n") >= least_count)).select(F.col("gram").alias("word"), "n")

    counts = lambda name: inner.select(F.col("gram").alias(name), F.col("n").alias(f"n_{name}"))
    cut = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")
    parts = listed.select("word", "n", cut).select("word", "n", F.expr("substring(word, 1, k)").alias("left"), F.expr("substring(word, k + 1)").alias("right"))
    chance = F.col("n_left").cast("double") * F.col("n_right") / total
    held = parts.join(counts("left"), "left").join(counts("right"), "right").groupBy("word", "n").agg(F.min(F.col("n") / chance).alias("cohesion"))
    held = settle(held.where(F.col("cohesion") >= least_cohesion), "held")

    def entropy(word: Column, within: Column, name: str) -> DataFrame:
        """Entropy of the one character that ``within`` leaves out of longer grams, per gram that it keeps."""
        around = grams.where(F.col("size") > 2).where(within).select(word.alias("word"), F.col("n").alias("m")).where(~F.contains("word", F.lit(EDGE)))
        m = F.col("m").cast("double")
        return around.groupBy("word").agg((F.log(F.sum(m)) - F.sum(m * F.log(m)) / F.sum(m)).alias(name))

    before = entropy(F.expr("substring(gram, 2)"), F.lit(True), "before")
    behind = entropy(F.expr("substring(gram, 1, size - 1)"), F.lit(True), "behind")
    varied = held.join(before, "word").join(behind, "word").where(F.least("before", "behind") >= least_entropy).select("word", "n")
    single = inner.where("size = 1").select(F.col("gram").alias("word"), "n")
    return settle(varied.unionByName(single).withColumn("weight", F.log(F.col("n") / F.lit(float(total)))), "words")


def best_split(run: str, weights: dict[str, float], most_letters: int) -> list[str]:
    """The words of one run: for each place the best word that ends there, then back from the end."""
    scores, taken = [0.0], [0]
    for end in range(1, len(run) + 1):
        best, k_best = scores[end - 1] + weights.get(run[end - 1], UNKNOWN), 1
        for k in range(2, min(end, most_letters) + 1):
            own = weights.get(run[end - k:end])
            if own is not None and scores[end - k] + own > best:
                best, k_best = scores[end - k] + own, k
        scores.append(best)
        taken.append(k_best)
    words, end = [], len(run)
    while end:
        words.append(run[end - taken[end]:end])
        end -= taken[end]
    return words[::-1]


def split_runs(found: DataFrame, words: DataFrame, most_letters: int = MOST_LETTERS) -> DataFrame:
    """(run, words): the split of each run whose words have the largest sum of weights, of equal ones that with the shorter last words.

    The words that a run offers are looked up by a join and come back as one map per run; the best split is found in Arrow batches. Characters
    are words of their own weight, so there is always a split; one that no list holds weighs less than any that does."""
    offered = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("run", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in range(1, most_letters + 1)])))
    met = found.select("run", F.explode(offered).alias("word")).join(words.select("word", "weight").where("weight IS NOT NULL"), "word")
    listed = met.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weights"))
    given = found.select("run").join(listed, "run", "left").withColumn("weights", F.coalesce("weights", F.create_map().cast("map<string,double>")))

    @F.pandas_udf("array<string>")
    def best(runs: pd.Series, words: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([best_split(run, dict(zip(w.tolist(), x.tolist())), most_letters) for run, w, x in zip(runs, words, weights)], dtype=object)

    return given.select("run", best("run", F.map_keys("weights"), F.map_values("weights")).alias("words"))


def segment(df: DataFrame, keys: list[str], content: str = "content", pattern: str = RUNS, words: DataFrame | None = None, **limits) -> DataFrame:
    """(keys, token, n): the words of every text's runs, each with its count in the text. ``words`` (word, weight) replaces those
    found in the texts themselves.

    Null and empty texts, and texts without a run, have no tokens. Jobs run when this is called."""
    found = settle(runs(df, content, pattern), "runs")
    most = limits.get("most_letters", MOST_LETTERS)
    listed = find_words(found, **limits) if words is None else words
    split = settle(split_runs(found, listed, most), "run-words")
    here = df.select(*keys, F.explode(F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(f"({pattern})"), F.lit(1))).alias("run"))
    counted = here.groupBy(*keys, "run").agg(F.count("*").alias("times"))
    return counted.join(split, "run").select(*keys, "times", F.explode("words").alias("token")).groupBy(*keys, "token").agg(F.sum("times").alias("n"))
