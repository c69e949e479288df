"""Benchmark decontamination: test items found in training passages by BM25 with block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrisk.llm.graphs import numbered, without
from voxrisk.session import settle

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: A passage is PASSAGE words, the next begins STEP words later: PASSAGE - STEP words in a row always lie in one passage.
PASSAGE, STEP = 160, 80
#: Items of more words are indexed in pieces of so many, so that a piece fits into one passage.
ITEM_WORDS = 80
#: Items of fewer words have too few triples to be told by a share of them; they have to stand in a passage as they are.
SHORT = 5
#: Share of an item's own BM25 score that a passage has to reach.
SCORE_SHARE = 0.6
#: Share of the word triples of the question, and of the answer, that the passage has to hold.
OVERLAP = 0.6
BLOCK = 16  # postings of one block
#: Words of the items in one index shard. A shard is broadcast, larger item tables are searched shard by shard.
SHARD_WORDS = 200_000
TEXTS_AT_ONCE = 256  # bounds the words that a task holds


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(words: list[str], question_words: int) -> tuple[list[str], list[str]]:
    return words[:question_words], words[question_words:]


def triples(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of three words; of fewer, the whole."""
    n = min(3, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def parts_of(question: list[str], answer: list[str]) -> tuple[set[tuple[str, ...]], set[tuple[str, ...]]]:
    """What a passage has to hold of a piece: triples of question and answer, or a short piece's whole run of words."""
    whole = tuple(question + answer)
    return ({whole} if whole else set(), set()) if len(whole) < SHORT else (triples(question), triples(answer))


def held(part: set[tuple[str, ...]], passage: list[str]) -> float:
    """Share of the runs that occur in the passage; an empty part is held."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    have = {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}
    return len(part & have) / len(part)


@dataclass
class Index:
    """Inverted index of item pieces. Weights are BM25 contributions divided by the piece's score against itself, so one
    threshold holds for all pieces. Postings of a word are sorted by piece and cut into blocks, each with its largest weight."""

    items: list[int]  # row number of the item that a piece is of
    questions: list[set]
    answers: list[set]
    words: dict[str, int]
    postings: list[np.ndarray]  # pieces by word
    weights: list[np.ndarray]
    most: np.ndarray  # largest weight by word
    #: Telling words by number. The others, found in more than LIGHT of all pieces, can add ``light`` to a range at most.
    telling: dict[str, int]
    light: np.ndarray
    #: Largest weight by word and range of RANGE pieces: for word t the entries begin[t] to begin[t + 1].
    begin: np.ndarray
    range_of: np.ndarray
    range_most: np.ndarray
    n_ranges: int


RANGE = 2
LIGHT = 0.05


def build_index(pieces: list[tuple[int, list[str], list[str]]], idf: dict[str, float], mean_words: float) -> Index:
    """``pieces``: (item, question words, answer words). idf and mean length are those of all items, not of the shard's."""
    words: dict[str, int] = {}
    posted: list[list[tuple[int, float]]] = []
    for p, (_, question, answer) in enumerate(pieces):
        counts = Counter(question + answer)
        n = sum(counts.values())
        part = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * n / mean_words)) for w, c in counts.items()}
        own = sum(part.values()) or 1.0
        for w, x in part.items():
            if w not in words:
                words[w] = len(posted)
                posted.append([])
            posted[words[w]].append((p, x / own))
    begin, range_of, range_most = [0], [], []
    for rows in posted:
        most: dict[int, float] = {}
        for p, x in rows:
            most[p // RANGE] = max(most.get(p // RANGE, 0.0), x)
        range_of += most
        range_most += most.values()
        begin.append(len(range_of))
    few = max(3, LIGHT * len(pieces))
    telling = {w: t for w, t in words.items() if len(posted[t]) <= few}
    light = np.zeros(len(pieces) // RANGE + 1)
    rest = [0.0] * len(pieces)
    for w, t in words.items():
        if w not in telling:
            for p, x in posted[t]:
                rest[p] += x
    for p, x in enumerate(rest):
        light[p // RANGE] = max(light[p // RANGE], x)
    wanted = [parts_of(x[1], x[2]) for x in pieces]
    return Index(
        [x[0] for x in pieces], [q for q, _ in wanted], [a for _, a in wanted], words,
        [np.array([p for p, _ in rows]) for rows in posted], [np.array([x for _, x in rows]) for rows in posted],
        np.array([max(x for _, x in rows) for rows in posted]), telling, light, np.array(begin), np.array(range_of, np.int64), np.array(range_most), len(pieces) // RANGE + 1)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All pieces whose weights for the terms sum to the threshold or more, in order of piece.

    Cursors stand on the next piece of each term. The pivot is the first piece at which the terms' largest
    weights could reach the threshold; before it is scored, the largest weights of the blocks that hold it are summed, and where
    they fall short all cursors jump behind the nearest end of those blocks."""
    lists = [[index.postings[t], index.weights[t], float(index.most[t]), 0] for t in terms]
    found = []
    while True:
        lists = [x for x in lists if x[3] < len(x[0])]
        lists.sort(key=lambda x: x[0][x[3]])
        total, pivot = 0.0, None
        for i, x in enumerate(lists):
            total += x[2]
            if total >= threshold - 1e-9:
                pivot = int(x[0][x[3]])
                break
        if pivot is None:
            return found
        while i + 1 < len(lists) and lists[i + 1][0][lists[i + 1][3]] == pivot:
            i += 1
        reach, end = 0.0, None
        for x in lists[:i + 1]:
            at = bisect_left(x[0], pivot, x[3])
            if at < len(x[0]):
                begin = at - at % BLOCK
                stop = min(begin + BLOCK, len(x[0]))
                reach += float(x[1][begin:stop].max())
                last = int(x[0][stop - 1])
                end = last if end is None else min(end, last)
        if reach >= threshold - 1e-9:
            score, at_pivot = 0.0, []
            for x in lists[:i + 1]:
                x[3] = bisect_left(x[0], pivot, x[3])
                if x[3] < len(x[0]) and x[0][x[3]] == pivot:
                    score += float(x[1][x[3]])
                    at_pivot.append(x)
            for x in at_pivot:
                x[3] += 1
            if score >= threshold - 1e-9:
                found.append((pivot, score))
        else:
            after = max(pivot, end if end is not None else pivot) + 1
            if i + 1 < len(lists):  # a later term's piece may lie before the end of the blocks
                after = min(after, int(lists[i + 1][0][lists[i + 1][3]]))
            after = max(after, pivot + 1)
            for x in lists[:i + 1]:
                x[3] = bisect_left(x[0], after, x[3])


def passage_terms(texts: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct known words of every passage: (text, first word, at, term), ``at`` being the passage of each term.

    Passage i of a text begins at word i * STEP and has PASSAGE = 2 * STEP words, the last one ends with the text."""
    n = np.array([len(words) for words in texts], np.int64)
    many = np.maximum(1, -(-(n - PASSAGE + STEP) // STEP))
    base = np.append(0, np.cumsum(many))
    number = known.get
    terms = np.array([number(w, -1) for words in texts for w in words], np.int32)
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(n) - n, n)
    hit = terms >= 0
    terms, text, place = terms[hit].astype(np.int64), text[hit], place[hit]
    width = max(known.values(), default=0) + 1
    keys = []
    for back in range(PASSAGE // STEP):
        i = place // STEP - back
        fits = (i >= 0) & (i < many[text])
        keys.append((base[text[fits]] + i[fits]) * width + terms[fits])
    keys = np.unique(np.concatenate(keys))
    spans, term = np.divmod(keys, width)
    span = np.arange(base[-1])
    owner = np.repeat(np.arange(len(texts)), many)
    return owner, (span - base[owner]) * STEP, spans, term


def screened(index: Index, at: np.ndarray, term: np.ndarray, passages: int, threshold: float) -> np.ndarray:
    """Passages that could reach the threshold: in some range of pieces the largest weights of their telling words, and
    all that other words can add there, sum to it."""
    count = index.begin[term + 1] - index.begin[term]
    entry = np.repeat(index.begin[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
    reach = np.bincount(np.repeat(at, count) * index.n_ranges + index.range_of[entry], index.range_most[entry], passages * index.n_ranges)
    return np.flatnonzero((reach.reshape(passages, -1) + index.light >= threshold - 1e-9).any(axis=1))


def item_pieces(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, row, question array, answer array): words of each item, cut into pieces of at most ITEM_WORDS.

    The answer is what follows the last line break but closing ones, or else the last question or sentence end; a text of one
    sentence is halved. Where the last piece would have fewer than SHORT words, it begins SHORT words earlier. Only items without
    words take no part."""
    kind = items.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, questions, answers = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = (text or "").strip()
                ends = [m.end() for m in re.finditer(r"\n|[.?!](?=\s)", text)]
                lines = [e for e in ends if text[e - 1] == "\n"]
                words = words_of(text)
                n = len(words_of(text[:(lines or ends or [0])[-1]])) or len(words) // 2
                cuts = list(range(0, len(words), ITEM_WORDS))
                if len(cuts) > 1 and len(words) - cuts[-1] < SHORT:
                    cuts[-1] -= SHORT
                for k, end in zip(cuts, [*cuts[1:], len(words)]):
                    part = words[k:end]
                    at.append(i)
                    number.append(k)
                    q, a = question_and_answer(part, min(max(n - k, 0), len(part)))
                    questions.append(q)
                    answers.append(a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(questions, pa.list_(pa.string())), pa.array(answers, pa.list_(pa.string()))],
                ["item", "number", "question", "answer"])

    return items.select(items[id_col].alias("item"), items[text_col].alias("text")).mapInArrow(
        cut, f"item {kind}, number int, question array<string>, answer array<string>")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    score_share: float = SCORE_SHARE, overlap: float = OVERLAP, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Every (document, item) of which a passage holds the item: id, item, score, question_overlap, answer_overlap, start.

    Each passage of every document is a BM25 query to the index of test items; all items whose score reaches
    ``score_share`` of their own are taken (no best-k limit), and confirmed if the passage holds ``overlap`` of the word triples of the
    question and of the answer. Items of fewer than SHORT words are confirmed where all their words stand in a row, so one of a single word is held
    by every document with that word. Per document and item the passage with the largest (least overlap, score), the first of
    equals, is returned, ``start`` being its first word; an item of several pieces by its best piece.

    Rows of items that share an id are one item; those without an id are one each. The index is cut by hash into shards of about ``shard_words`` words of items, each broadcast and searched in a pass of its own,
    so the items may be many. Null and empty texts hold nothing; null ids are kept as they are; repeated rows give
    repeated results; other columns are not read. Jobs run when this is called."""
    pieces = settle(item_pieces(items, item_id, item_text), "items")
    place = F.when(F.col("item").isNull(), F.xxhash64("question", "answer")).otherwise(F.xxhash64("item"))  # items without an id are dealt by their words
    size = F.size("question") + F.size("answer")
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = max(1, math.ceil(total / shard_words))
    per_word = pieces.select("item", "number", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    seen = settle(pieces.select("*", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word")).join(per_word, "word").groupBy(
        "item", "number", "question", "answer").agg(F.collect_list(F.struct("word", "df")).alias("df")), "items-df")
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    out = None
    for shard in range(shards):
        rows = seen.where(F.pmod(place, F.lit(shards)) == shard).collect()  # of bounded size
        found = _search(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), docs.sparkSession, rows, n, total / max(1, n), kind, item_kind, score_share, overlap)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_id)


def _search(docs: DataFrame, spark: SparkSession, rows: list, n: int, mean_words: float, kind: str, item_kind: str, share: float, overlap: float) -> DataFrame:
    idf = {x.word: math.log(1 + (n - x.df + 0.5) / (x.df + 0.5)) for r in rows for x in r.df}
    # rows without an id stay apart; the pieces of an item count as one
    rows = sorted(rows, key=lambda r: (r.item is None, 0 if r.item is None else r.item, r.number, r.question, r.answer))
    names, given = [], []
    for r in rows:
        if not names or r.item is None or r.item != names[-1]:
            names.append(r.item)
        given.append((len(names) - 1, list(r.question), list(r.answer)))
    shared = spark.sparkContext.broadcast((build_index(given, idf, mean_words), names))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, item_of = shared.value
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            owner, first, at, term = passage_terms(texts, index.telling)
            best: dict[tuple[int, int], tuple] = {}
            for k in screened(index, at, term, len(owner), share):
                d, s = int(owner[k]), int(first[k])
                passage = texts[d][s:s + PASSAGE]
                terms = sorted({index.words[w] for w in passage if w in index.words})
                for piece, score in block_max_wand(index, terms, share):
                    q, a = held(index.questions[piece], passage), held(index.answers[piece], passage)
                    if min(q, a) >= overlap:
                        key, value = (d, index.items[piece]), (min(q, a), score, -s, q, a)
                        if key not in best or value > best[key]:
                            best[key] = value
            hits = sorted(best)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([d for d, _ in hits], pa.int64())), pa.array([item_of[i] for _, i in hits], item_type),
                *(pa.array([float(best[h][k]) for h in hits], pa.float64()) for k in (1, 3, 4)), pa.array([-best[h][2] for h in hits], pa.int64())],
                ["id", "item", "score", "question_overlap", "answer_overlap", "start"])

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    return docs.mapInArrow(look, f"id {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double, start long")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no test item, with the columns that came in. Rows with a null id are judged by their own text."""
    held = numbered(docs)
    place = {name: c for c, name in zip(held.columns, docs.columns)}
    keyed = held.withColumn("_row", F.struct(F.col(place["doc_id"]), F.xxhash64(place["text"])).cast("string"))
    gone = settle(contaminated(keyed, items, id_col="_row", text_col=place["text"]).select("_row").distinct(), "contaminated")
    return without(keyed, "_row", gone, "_row").drop("_row").toDF(*docs.columns)
