"""Collocations: FM-indexes over word ids, one per shard, whose phrase counts are summed across shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrisk.operators.scaling import top_k
from voxrisk.session import settle

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
NO_LANG = "und"
#: What ends a piece of text, and what stands between words.
ENDS, BLANKS = ".,;:!?\x0A\x0B\x0C\x0D", "\x20\x09"
SHARD_BYTES = 8 << 20  # text that one index covers
MAP_WORDS = 1 << 17  # 64-bit words of a filter: 1 MB
TAIL_SALTS = 4  # buckets that the phrases of one beginning are dealt into
END = "\n"  # what all ends of pieces become
_FOLD = bytes.maketrans((ENDS + "\t" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ").encode(), (END * len(ENDS) + " " + "abcdefghijklmnopqrstuvwxyz").encode())


# --- text to word ids ------------------------------------------------------------------
def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes]]:
    """(lang, folded text) of about ``most`` bytes from rows (lang, text); cut only where a piece ends. All that is held back stays
    below a few times ``most``, however many languages there are, unless a single piece is longer."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def full(lang: str) -> Iterator[tuple[str, bytes]]:
        whole, at = END.encode().join(held.pop(lang)), 0
        del size[lang]
        while len(whole) - at > most:
            cut = whole.rfind(b"\n", at, at + most)
            cut = whole.find(b"\n", at + most) if cut < 0 else cut
            if cut < 0:
                break
            yield lang, whole[at:cut]
            at = cut + 1
        yield lang, whole[at:]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text.encode().translate(_FOLD))
                size[lang] = size.get(lang, 0) + len(held[lang][-1]) + 1
                if size[lang] >= most:
                    yield from full(lang)
        while sum(size.values()) > 2 * most:
            yield from full(max(size, key=size.get))
        pa.default_memory_pool().release_unused()  # a worker would keep what its largest text took
    for lang in list(held):
        yield from full(lang)


def _words(chunk: bytes) -> tuple[np.ndarray, pa.Array]:
    """Word numbers of a text in order, 0 where a piece ends, and the words: number w is the word at w - 1."""
    spaced = pa.array([chunk.replace(b"\n", b" \n ")], pa.binary()).cast(pa.large_string())
    coded = pc.split_pattern(spaced, " ").flatten().dictionary_encode()
    known = coded.dictionary
    ends, blank = (pc.equal(known, x).to_numpy(zero_copy_only=False) for x in (END, ""))
    number = np.cumsum(~(ends | blank)).astype(np.int32)
    number[ends], number[blank] = 0, -1
    symbols = number[coded.indices.to_numpy()]
    return symbols[symbols >= 0], known.filter(pa.array(~(ends | blank)))


# --- filters: one bit for each of 8 million values of a hash ------------------------------
def _word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _spots(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Bit numbers of phrases in one language, whose words' hashes are the rows of ``hashes``."""
    h = np.full(len(hashes), xxhash.xxh64_intdigest(lang, hashes.shape[1]), np.uint64)
    for column in hashes.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)  # an odd number without pattern
        h ^= h >> np.uint64(29)
    return h % np.uint64(64 * MAP_WORDS)


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-zero words of the filter of a task's (lang, phrase) rows; all phrases have the same number of words."""
    found = np.zeros(MAP_WORDS, np.uint64)
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        words = pc.split_pattern(batch.column(1), " ")
        coded = words.flatten().dictionary_encode()
        hashes = _word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()].reshape(len(langs), -1)
        for lang in set(langs):
            spots = _spots(hashes[langs == lang], lang)
            np.bitwise_or.at(found, (spots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spots & np.uint64(63)))
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))], ["word", "bits"])


def phrase_filter(phrases: DataFrame) -> np.ndarray:
    """Filter of fixed size that holds all of ``phrases`` (lang, phrase), and a few others: it tells surely what is not among them."""
    rows = phrases.select("lang", "phrase").mapInArrow(_set_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(MAP_WORDS, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint64)
    return out


def _maybe(hashes: np.ndarray, lang: str, known: np.ndarray) -> np.ndarray:
    spots = _spots(hashes, lang)
    return (known[(spots >> np.uint64(6)).astype(np.int64)] >> (spots & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- the index of a shard ----------------------------------------------------------------
def _stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of small whole numbers, 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    if len(keys) and int(keys.max()) >> 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Burrows-Wheeler transform whose suffixes are sorted by their first ``depth`` symbols, enough to look up phrases of
    up to ``depth`` words. ``symbols`` ends with 0, which no phrase holds."""
    order = np.arange(len(symbols))
    for k in reversed(range(depth)):
        order = order[_stable_order(np.roll(symbols, -k)[order])]
    return symbols[order - 1]


def index_shard(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform of the text, transform of the text read backwards)."""
    return transform(symbols, depth), transform(np.append(symbols[:-1][::-1], symbols[-1:]), depth)


class Side:
    """One direction of a shard's index, ready to extend phrases by a word at that side."""

    def __init__(self, bwt: np.ndarray, counts: np.ndarray) -> None:
        self.order = _stable_order(bwt).astype(np.int32)  # row of the n-th symbol in sorted order: the inverse of the last-to-first mapping
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    def extend(self, near: np.ndarray, far: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of phrases by one word: (phrase, word, near, far, size).

        A phrase is an interval of rows in the index that this side reads, starting at ``near``, and one as long in the index
        of the other direction, starting at ``far``; the phrases' intervals don't overlap. The rows that a phrase shares with a word in
        the transform become, by the last-to-first mapping, the near interval of the extended phrase; how many of its rows hold smaller
        words places the far one."""
        owner = np.full(len(self.order), -1, np.int32)
        ends = np.cumsum(size)
        owner[np.repeat(near - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)] = np.repeat(np.arange(len(size), dtype=np.int32), size)
        owner = owner[self.order]
        at = np.flatnonzero(owner >= 0)
        who, word = owner[at], self.symbol[at]
        first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (word[1:] != word[:-1]))) if len(at) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(at)))
        who, word, near = who[first], word[first], at[first]
        by_owner = np.argsort(who, kind="stable")  # words stay in order
        before = np.cumsum(count[by_owner]) - count[by_owner]
        starts = np.flatnonzero(np.append(True, np.diff(who[by_owner]) != 0)) if len(who) else np.zeros(0, np.int64)
        smaller = np.empty_like(before)
        smaller[by_owner] = before - np.repeat(before[starts], np.diff(np.append(starts, len(who))))
        kept = word > 0
        return who[kept], word[kept], near[kept], (far[who] + smaller)[kept], count[kept]


def grow(words: list[str], bwt: np.ndarray, backward: np.ndarray, lang: str, filters: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, counts) of the shard's phrases of ``length`` words whose parts may all be frequent.

    ``filters`` hold the frequent phrases of 1, 2 ... words. Phrases grow by turns on the right and on the left, both of their intervals kept in step; what
    a filter does not hold is left at once, so only its rows are followed further."""
    counts = np.bincount(bwt, minlength=len(words) + 1)
    hashes = np.append(np.zeros(1, np.uint64), _word_hashes(words))
    sides: dict[bool, Side] = {}
    phrases = np.arange(1, len(counts))[:, None]
    at, size = {False: np.cumsum(counts)[:-1], True: np.cumsum(counts)[:-1]}, counts[1:]  # starts in the forward and the backward index
    for n in range(2, length + 1):
        right = n % 2 == 0  # what stands right of a phrase is what precedes it read backwards
        if right not in sides:
            sides[right] = Side(backward if right else bwt, counts)
        who, word, near, far, size = sides[right].extend(at[right], at[not right], size)
        phrases = np.hstack([phrases[who], word[:, None]] if right else [word[:, None], phrases[who]])
        new = phrases[:, 1:] if right else phrases[:, :-1]  # the other part is the phrase that was extended
        kept = _maybe(hashes[new], lang, filters[n - 2])
        if n < length:
            kept &= _maybe(hashes[phrases], lang, filters[n - 1])
        phrases, size = phrases[kept], size[kept]
        at = {right: near[kept], not right: far[kept]}
    return phrases, size


# --- Spark jobs ----------------------------------------------------------------------------
def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), docs[text_col].alias("text"))


def _packed(lang: str, words: pa.Array, phrases: np.ndarray, counts: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(lang, bucket, phrases, counts) of phrases, rows of word numbers: all phrases of a bucket are the lines of one row, in order,
    so that they begin alike and compress well. It takes half the bytes of a row for each. Phrases that begin alike lie in TAIL_SALTS buckets."""
    of_head = _spots(hashes[phrases[:, :-1]], lang) * np.uint64(phrases.shape[1] > 1)  # the beginning, and a part of the last word
    tail = hashes[phrases[:, -1]]
    bucket = ((of_head + (tail % np.uint64(TAIL_SALTS) if phrases.shape[1] > 1 else tail)) % np.uint64(buckets)).astype(np.int64)
    order = np.arange(len(phrases))
    for column in (*phrases.T[::-1], bucket):
        order = order[_stable_order(column[order])]
    phrases, bucket = phrases[order], bucket[order]
    starts = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
    offsets = pa.array(np.append(starts, len(phrases)).astype(np.int32))
    together = lambda values: pc.binary_join(pa.ListArray.from_arrays(offsets, values.cast(pa.string())), END)
    known = words.cast(pa.string())
    text = pc.binary_join_element_wise(*(known.take(pa.array(column - 1)) for column in phrases.T), " ")
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(starts)), pa.array(bucket[starts].astype(np.int32)), together(text), together(pa.array(counts[order]))],
        ["lang", "bucket", "phrases", "counts"])


PACKED = "lang string, bucket int, phrases string, counts string"


def _buckets(spark: SparkSession) -> int:
    """A few for every task that sums."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _summed(packed: DataFrame) -> DataFrame:
    """(lang, phrase, n) over all shards. Rows are dealt out by the bucket that they hold once, so that the sums need no further exchange."""
    dealt = packed.repartition("lang", "bucket")
    pairs = F.arrays_zip(F.split("phrases", END).alias("phrase"), F.split("counts", END).alias("n"))
    n = dealt.select("lang", "bucket", F.inline(pairs)).groupBy("lang", "bucket", "phrase").agg(F.sum(F.col("n").cast("long")).alias("n"))
    return n.select("lang", "phrase", "n")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words, and with the empty phrase of each language's words together."""
    buckets = _buckets(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches, SHARD_BYTES):
            symbols, words = _words(chunk)
            n = np.bincount(symbols, minlength=len(words) + 1)[1:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([-1], pa.int32()), pa.array([""]), pa.array([str(n.sum())])], ["lang", "bucket", "phrases", "counts"])
            if len(words):
                hashes = np.append(np.zeros(1, np.uint64), _word_hashes(words.to_pylist()))
                yield _packed(lang, words, np.arange(1, len(words) + 1)[:, None], n, hashes, buckets)

    return _summed(texts.mapInArrow(count, PACKED))


def shards(texts: DataFrame, frequent: np.ndarray, depth: int) -> DataFrame:
    """(lang, words, forward, backward, kind): the indexes of all shards, over the words that may be frequent, and the kind of their numbers. Others end a piece, as no
    phrase with such a word can be frequent."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches, SHARD_BYTES):
            symbols, words = _words(chunk)
            kept = _maybe(_word_hashes(words.to_pylist())[:, None], lang, frequent)
            number = np.append(0, np.where(kept, np.cumsum(kept), 0)).astype(np.int32)
            symbols = np.concatenate([[0], number[symbols], [0]]).astype(np.int32)
            symbols[1:-1][(symbols[:-2] == 0) & (symbols[2:] == 0)] = 0  # a word alone is in no phrase
            symbols = symbols[1:][(symbols[1:] > 0) | (symbols[:-1] > 0)]
            if len(symbols):
                bwt, backward = index_shard(symbols, depth)
                known = words.filter(pa.array(kept)).to_pylist()
                kind = "<u2" if len(known) < 1 << 16 else "<i4"
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang]), pa.array([known], pa.list_(pa.string())), pa.array([bwt.astype(kind).tobytes()], pa.binary()),
                    pa.array([backward.astype(kind).tobytes()], pa.binary()), pa.array([kind])], ["lang", "words", "forward", "backward", "kind"])

    return texts.mapInArrow(build, "lang string, words array<string>, forward binary, backward binary, kind string")


def phrase_counts(index: DataFrame, filters: list[np.ndarray], length: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``length`` words whose parts may all be frequent, over all shards."""
    buckets = _buckets(index.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pa.default_memory_pool().release_unused()
                lang, words, forward, backward, kind = (batch.column(c)[row] for c in range(5))
                lang, words, kind = lang.as_py(), words.values, kind.as_py()
                known = words.to_pylist()
                phrases, size = grow(known, *(np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in (forward, backward)), lang, filters, length)
                if len(size):
                    yield _packed(lang, words, phrases, size, np.append(np.zeros(1, np.uint64), _word_hashes(known)), buckets)

    return _summed(index.mapInArrow(count, PACKED))


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def score_cuts(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words and more, by the cut that scores lowest; ties to the earliest.

    The parts of a frequent phrase are frequent, so their counts are in the same table. Products are decimals of up to 36 digits,
    exact for counts below 10^15."""
    cuts = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
            k.alias("k"), _part(F.lit(1), k).alias("left"), _part(k + 1, F.size("words") - k).alias("right")))).alias("cut")
    ).select("lang", "phrase", "a", "cut.*")
    counts = lambda part, name: frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    exact = lambda name: F.col(name).cast("decimal(15,0)")
    scored = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"]).join(F.broadcast(totals), "lang").withColumns({
        "over": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")), "under": exact("l") * exact("r")}).withColumn("score", F.expr("over div under"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_absorbed(scored: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """Phrases of which no longer frequent phrase keeps ``percent`` of the occurrences, with their most frequent left and right extension.

    A phrase between two others is at least as frequent as the longer one, so extensions by one word decide."""
    longer = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    inner = F.size("words") - 1
    sides = F.array(
        F.struct(_part(F.lit(2), inner).alias("phrase"), F.col("n").alias("left_most"), F.lit(0).cast("bigint").alias("right_most")),
        F.struct(_part(F.lit(1), inner).alias("phrase"), F.lit(0).cast("bigint").alias("left_most"), F.col("n").alias("right_most")))
    most = longer.select("lang", F.inline(sides)).groupBy("lang", "phrase").agg(F.max("left_most").alias("left_most"), F.max("right_most").alias("right_most"))
    told = scored.join(most, ["lang", "phrase"], "left").fillna(0, ["left_most", "right_most"])
    return told.where(100 * F.greatest("left_most", "right_most") < percent * F.col("a"))


def mine_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, absorb_percent: int = 100,
) -> DataFrame:
    """The ``top`` collocations of each language.

    Texts are folded to lower case (A to Z), split into pieces at ENDS and into words at BLANKS. Phrases of 2 to ``max_words`` words within a piece that
    occur at least ``min_count`` times are scored by floor(1000 a n / (l r)) of their worst cut into two parts, a being the count of the phrase, l and r of
    its parts and n of all words. Those of which a longer phrase keeps ``absorb_percent`` of the occurrences go. Returns lang, rank, phrase, a, l, r, n,
    score, left_most and right_most (counts of the most frequent extension at either side, 0 if none is frequent).

    Tasks turn about SHARD_BYTES of text of one language into an index. Each length is counted over all shards before the next: a phrase can only be
    frequent if both of its parts are, which filters of a fixed size tell the tasks. They may let others pass, whose exact sums then sort them out.

    A null language is ``und``; null and empty texts have no words; repeated rows count each. Other columns are not read. An empty table
    gives no rows. A single piece longer than SHARD_BYTES makes a larger index. Jobs run when this is called."""
    texts = _texts(docs, lang_col, text_col)
    counted = settle(word_counts(texts).where((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrase-words")
    totals = settle(counted.where("phrase = ''").select("lang", "n"), "phrase-totals")
    levels = [counted.where("phrase <> ''").select("lang", "phrase", "n")]
    filters = [phrase_filter(levels[0])]
    index = settle(shards(texts, filters[0], max_words), "phrase-index")
    for length in range(2, max_words + 1):
        levels.append(settle(phrase_counts(index, filters, length).where(F.col("n") >= min_count), "phrase-level"))
        if length < max_words:
            filters.append(phrase_filter(levels[-1]))
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)
    kept = without_absorbed(score_cuts(frequent, totals), frequent, absorb_percent)
    best = top_k(kept, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top, spread_on=["phrase"])
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_most", "right_most")
