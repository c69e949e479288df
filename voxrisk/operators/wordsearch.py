"""Which listed words occur in which texts, for lists of any length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from voxrisk.session import settle

PAIR, GRAM = 2, 4
#: Lists up to this many words are handed to the tasks and looked for in place; longer ones are met by ``word_index``, with the same result.
MAX_HELD_WORDS = 250_000


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, overlapping ones too."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _offered(text: Column, singles: bool) -> Column:
    """The different pairs of neighbouring characters of a text, and its characters if words of one character are listed."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(_grams(text, PAIR), _grams(text, 1)) if singles else _grams(text, PAIR))


def word_index(texts: DataFrame, words: DataFrame, content: str = "content") -> tuple[DataFrame, bool]:
    """((gram, word), whether there are words of one character): every word once, under the pair of its characters that the fewest
    texts hold, the smallest of equals; a word of one character under itself.

    The texts are read once and only counts of pairs leave the tasks. A word with a pair that no text holds occurs nowhere and
    is left out. Empty and null words are no words."""
    listed = settle(words.select("word").where("word <> ''").distinct(), "words")
    size = F.length("word")
    parts = listed.select("word", F.explode(F.array_distinct(F.when(size == 1, F.array("word")).otherwise(_grams(F.col("word"), PAIR)))).alias("gram"))
    singles = not listed.where(size == 1).isEmpty()
    wanted = settle(parts.select("gram").distinct(), "grams")
    held = texts.select(F.explode(_offered(F.col(content), singles)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    counts = held.join(wanted, "gram", "left_semi")
    rare = parts.join(counts, "gram", "left").groupBy("word").agg(
        F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "gram")).alias("rarest"))
    return settle(rare.where("absent = 0").select("rarest.gram", "word"), "word-index"), singles


class _Search:
    """Which of the listed words (repeated ones too) stand in which texts of a batch.

    Each word is filed under one of its grams, that which it shares with the fewest others, in a table of slots; words shorter than GRAM
    under themselves. Every place of the texts looks into the slot of its gram, and what is filed there is compared character by character."""

    AT_ONCE = 1 << 20  # characters of a batch that are looked at together, one longer text as a whole

    def __init__(self, words: Sequence[str]) -> None:
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.codes = self._codes("".join(words))
        self.offsets = np.zeros(len(words), np.int64)
        self.bits = max(16, min(22, (16 * len(words)).bit_length()))
        grams = [[w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))] for w in words]
        shared = Counter(g for own in grams for g in set(own))
        filed: dict[int, list[int]] = {}
        for i, own in enumerate(grams):
            self.offsets[i] = min(range(len(own)), key=lambda k: shared[own[k]])
            filed.setdefault(len(own[0]), []).append(i)
        self.tables = {}
        for size, ids in filed.items():
            at = self.begins[ids] + self.offsets[ids]
            slots = self._slots(self.codes, size)[at]
            order = np.argsort(slots, kind="stable")
            self.tables[size] = np.searchsorted(slots[order], np.arange((1 << self.bits) + 1)), np.array(ids)[order]

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), "<u4")

    def _slots(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The slot of the gram that begins at each place; different grams may share one."""
        n = max(0, len(codes) - size + 1)
        key = codes[:n].astype(np.uint64)
        for k in range(1, size):
            key *= np.uint64(0x9E3779B1)
            key += codes[k : n + k]
        key *= np.uint64(0x9E3779B97F4A7C15)
        key >>= np.uint64(64 - self.bits)
        return key.astype(np.int64)

    def _chunk(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = self._codes("".join(texts))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = [np.zeros(0, np.int64)]
        for size, (starts, filed) in self.tables.items():
            slots = self._slots(codes, size)
            counts = starts[slots + 1] - starts[slots]
            place = np.flatnonzero(counts)
            counts = counts[place]
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            word = filed[np.repeat(starts[slots[place]], counts) + inside]
            text = np.repeat(np.searchsorted(bounds, place, "right") - 1, counts)
            start = np.repeat(place, counts) - self.offsets[word]
            fits = (start >= bounds[text]) & (start + self.lengths[word] <= bounds[text + 1])
            word, text, start = word[fits], text[fits], start[fits]
            k = 0
            while len(word):
                same = codes[start + k] == self.codes[self.begins[word] + k]
                k += 1
                ended = same & (self.lengths[word] == k)
                found.append(np.unique(text[ended] * len(self.lengths) + word[ended]))
                same &= ~ended
                word, text, start = word[same], text[same], start[same]
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.lengths)))

    def hits(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Texts and words that meet, by their numbers and in their order."""
        texts = [t or "" for t in texts]
        whose, which, low, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= self.AT_ONCE or i + 1 == len(texts):
                text_no, word_no = self._chunk(texts[low : i + 1])
                whose.append(text_no + low)
                which.append(word_no)
                low, size = i + 1, 0
        return np.concatenate(whose), np.concatenate(which)


def _held(listed: DataFrame) -> list[Row] | None:
    """The rows of a list that tasks may hold, else None."""
    rows = listed.limit(MAX_HELD_WORDS + 1).collect()
    return None if len(rows) > MAX_HELD_WORDS else rows


def _seen_in_place(df: DataFrame, entries: Sequence[tuple], fields: Sequence[str]) -> Callable[[Column], Column]:
    """Column function: array of those ``entries``, in their order, whose word (the first field) a text contains; of structs where they
    have several fields. The entries are broadcast once, and no row moves."""
    held = df.sparkSession.sparkContext.broadcast((_Search([entry[0] for entry in entries]), [list(c) for c in zip(*entries)] or [[] for _ in fields]))

    def seen(texts: pa.Array) -> pa.Array:
        search, columns = held.value
        whose, which = search.hits(texts.to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(texts)))])
        shown = [pa.array(c, pa.string()).take(pa.array(which)) for c in columns]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shown[0] if len(shown) == 1 else pa.StructArray.from_arrays(shown, names=list(fields)))

    kind = "array<string>" if len(fields) == 1 else f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"
    return F.arrow_udf(seen, kind)


def found_words(texts: DataFrame, words: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """(keys, word) for every listed word that a text contains, each once per row.

    Up to MAX_HELD_WORDS words are looked for where the texts are: a text is cut into its grams, and only words under one of them are
    tried. Only hits leave the task. For longer lists see ``indexed_words``. Null and empty texts contain nothing, an empty list nothing either."""
    listed = settle(words.select("word").where("word <> ''").distinct(), "words")
    held = _held(listed)
    if held is None:
        return indexed_words(texts, listed, keys, content)
    seen = _seen_in_place(texts, [tuple(r) for r in held], ["word"])
    # outer: a plain explode would search every text once more to test for emptiness
    hits = texts.select(*keys, F.explode_outer(seen(F.col(content))).alias("word"))
    return hits.where(F.col("word").isNotNull())


def indexed_words(texts: DataFrame, words: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """``found_words`` for a list of any length.

    Texts offer their pairs of characters, without the texts themselves, to the index; the few words met this way are looked for in the
    text, which moves once at most. A word costs work only where its rarest pair occurs. ``keys`` have to tell the rows apart; null keys
    are keys like others."""
    index, singles = word_index(texts, words, content)
    whole = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    offered = texts.select(*keys, F.explode(_offered(F.col(content), singles)).alias("gram"))
    met = offered.join(index, "gram").groupBy(*keys).agg(F.collect_list("word").alias("_met"))
    met = settle(met.withColumnsRenamed({k: f"_{k}" for k in keys}), "words-met")
    matched = whole[0]
    for more in whole[1:]:
        matched = matched & more
    beside = texts.select(*keys, F.col(content).alias("_text")).join(met, matched)
    # the outer explode keeps Spark from searching the texts a second time in a filter of its own
    hits = beside.select(*keys, F.explode_outer(F.filter("_met", lambda w: F.contains(F.col("_text"), w))).alias("word"))
    return hits.where(F.col("word").isNotNull())


def with_found(df: DataFrame, words: DataFrame, keys: Sequence[str], name: str, content: str = "content", lower: bool = False) -> DataFrame:
    """The rows with an array of the listed words that they contain, in the order of the list: ``words`` (place, word[, category]).

    With a category the array holds (word, category), else words. ``lower`` searches the text in lower case, as its rows keep it."""
    text = F.lower(content) if lower else F.col(content)
    fields = ["word", "category"] if "category" in words.columns else ["word"]
    order = ["place", *fields]
    listed = settle(words.select(*order).where("word <> ''").distinct(), "words")
    if (held := _held(listed.orderBy(*[F.asc_nulls_last(c) for c in order]))) is not None:
        return df.withColumn(name, _seen_in_place(df, [tuple(r[f] for f in fields) for r in held], fields)(text))
    searched = df.select(*keys, text.alias("_searched"))
    found = indexed_words(searched, words, keys, "_searched").join(words, "word")
    entry = F.struct("place", "word", "category") if "category" in words.columns else F.struct("place", "word")
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_set(entry)).alias("_hits")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    matched = F.lit(True)
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    if "category" in words.columns:
        shown = F.transform("_hits", lambda h: F.struct(h["word"].alias("word"), h["category"].alias("category")))
        none = F.array().cast("array<struct<word:string,category:string>>")
    else:
        shown, none = F.transform("_hits", lambda h: h["word"]), F.array().cast("array<string>")
    joined = df.join(settle(lists, "word-hits"), matched, "left")
    return joined.withColumn(name, F.coalesce(shown, none)).drop("_hits", *[f"_k_{k}" for k in keys])
