"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.llm.graphs import components, narrow, without
from voxrisk.session import settle, settle_last

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: A signature has POSITIONS values of 16 bits. CHUNKS runs of positions, each allowed ERRORS wrong
#: positions, cover every pair of signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 = 25
#: positions: were each run wrong in more, the sum would be larger. At a Jaccard similarity of 0.8 a
#: position differs with chance 0.2; more than 25 of 64 do so once in ten thousand pairs.
POSITIONS, CHUNKS, ERRORS = 64, 13, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
PARTS = [list(part) for part in np.array_split(np.arange(POSITIONS), CHUNKS)]
RUNS = np.array([p[0] for p in PARTS])  # first position of each run
RUN_OF = np.repeat(np.arange(CHUNKS), [len(p) for p in PARTS])
SLOTS = RUNS  # number of a run's first index key: one key for each position left out, so as many as positions before

BLOCK = 1 << 13
#: Buckets of more classes that lie in several components are compared in blocks, others as pairs of rows.
FEW, BLOCK_MEMBERS, BLOCK_SHINGLES = 24, 1024, 500_000

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_DRAW = np.random.default_rng(20240501)
FACTORS = _DRAW.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * U(2) + U(1)
OFFSETS = _DRAW.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash of a word, kept while it is among those seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words; of the whole sequence if it is shorter."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    size = min(size, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        acc = acc * U(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k]
    return np.unique(_mix(acc))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Lowest value of each of POSITIONS hash functions over the set, 16 bits of each."""
    low = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at:at + BLOCK]
        low = np.minimum(low, (part[None, :] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1))
    return (_mix(low) >> U(48)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each signature (row): for every run of positions, every choice of ERRORS = 1 position left out.

    The low six bits of a key are its number among the keys of a signature."""
    out = []
    for part in PARTS:
        for left in part:
            key = np.full(len(signatures), len(out) + 1, np.uint64)
            for p in part:
                if p != left:
                    key = _mix(key ^ (signatures[:, p].astype(np.uint64) + U(0x9E3779B97F4A7C15)))
            out.append((key & ~U(POSITIONS - 1)) | U(len(out)))
    return np.stack(out, axis=1).view(np.int64)


def _prepared(docs: DataFrame, size: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for text in batch["text"]:
                    s = shingle_set(text, size, hashes)
                    if len(s):
                        rows.append((len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(_mix(s + U(1))).view(np.int64)), signature(s).tobytes()))
                    else:
                        rows.append((0, 0, 0, b""))
                out = pd.DataFrame(rows, columns=["n", "d1", "d2", "sig"])
                out.insert(0, "id", batch["id"].to_numpy())
                yield out

    return docs.mapInPandas(read, "id string, n long, d1 long, d2 long, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                if len(batch):
                    keys = index_keys(np.frombuffer(b"".join(batch["sig"]), np.uint16).reshape(len(batch), POSITIONS))
                    yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(batch["rep"].to_numpy(), keys.shape[1])})

    return classes.select("rep", "sig").mapInPandas(read, "key long, rep long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, s): whole shingle sets of the documents whose ids are wanted, and of few others."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                yield pd.DataFrame({"rep": batch["id"], "s": [shingle_set(t, size, hashes).tobytes() for t in batch["text"]]})

    return narrow(docs, "id", wanted, "rep").mapInPandas(sets, "rep long, s binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have 100 * intersection >= percent * union.

    Only texts that occur in a pair are read into sets; the others stay where they are."""
    wanted = settle(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct(), "near-ids")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(len(x) > 0 and 100 * shared >= percent * (len(both) - shared))
            yield batch.loc[keep, ["a", "b"]]

    found = settle(_sets(docs, wanted, size), "near-sets")
    with_a = pairs.join(found.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a")
    return with_a.join(found.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")


def _shareable(crossing: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(rep, n, c): size of the set and how many of its shingles occur in another set of those still compared.

    Sets that can't reach the similarity with any other, since too few of their shingles are shared at all, are left out: a
    copy with many words of its own is refuted here, not in pairs with all the other copies."""
    reps = settle(crossing.select("rep").distinct(), "near-ids")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                for rep, text in zip(batch["id"], batch["text"]):
                    yield pd.DataFrame({"x": shingle_set(text, size, hashes).view(np.int64), "rep": rep})

    rows = narrow(docs, "id", reps, "rep").mapInPandas(shingles, "x long, rep long")
    alone = rows.groupBy("x").agg(F.count("*").alias("sets"), F.min("rep").alias("rep")).where("sets = 1").groupBy("rep").agg(F.count("*").alias("own"))
    known = reps.join(classes.select("rep", "n"), "rep").join(alone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"))
    return known.where(100 * F.col("c") >= percent * F.col("n"))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures differ in at most DISTANCE positions."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), POSITIONS) for c in ("x", "y"))
                yield batch.loc[(x != y).sum(axis=1) <= DISTANCE, ["a", "b"]]

    side = lambda c, x: classes.select(F.col("rep").alias(c), F.col("sig").alias(x))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(near, "a long, b long")


def _within_buckets(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of full buckets, by blocks: (a, b) that join different components.

    A bucket is divided by hash so that a block has at most about BLOCK_MEMBERS sets and BLOCK_SHINGLES shingles, and a
    task compares two blocks. A pair belongs to the first of its common buckets and is compared only there: first by
    signature distance, then by whole sets, and only while its components are not yet joined in this task. So a large
    group of similar texts yields few rows, whatever the number of its pairs."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(41)), F.col("blocks")).cast("int")
    # one row per class, with its at most POSITIONS buckets, meets the class's set and signature; only then it is dealt out
    held = members.groupBy("rep").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.first("c").alias("c"), F.collect_list(F.struct("key", blocks.alias("blocks"))).alias("buckets"))
    held = settle(held, "near-held")
    sets = settle(_sets(docs, held.select("rep"), size), "near-sets")
    rows = held.join(classes.select("rep", "sig"), "rep").join(sets, "rep").select("*", F.inline("buckets")).withColumn("own", own)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "rep", "component", "n", "c", "own", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "s", "sig")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep").sort_values(["own", "rep"])
        rep, component, n, c, own = (rows[x].to_numpy() for x in ("rep", "component", "n", "c", "own"))
        signatures = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), POSITIONS)
        slot = int(rows["key"].iloc[0]) & (POSITIONS - 1)
        _, flat = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["s"]]), return_inverse=True)
        start = np.append(0, np.cumsum([len(x) // 8 for x in rows["s"]]))
        length = np.diff(start)
        joined = {x: x for x in component.tolist()}

        def root(x: int) -> int:
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        found, second = [], own > own[0] if own[0] != own[-1] else None
        mark = np.zeros(len(flat) and int(flat.max()) + 1, bool)
        for x in range(len(rows) if second is None else int((~second).sum())):
            rest = np.arange(x + 1, len(rows)) if second is None else np.flatnonzero(second)
            common = np.minimum(c[x], c[rest])
            rest = rest[(component[rest] != component[x]) & (100 * common >= percent * (n[x] + n[rest] - common))]
            if not len(rest):
                continue
            wrong = signatures[rest] != signatures[x]
            errors = np.add.reduceat(wrong, RUNS, axis=1, dtype=np.int64)
            first = (errors <= ERRORS).argmax(axis=1)
            left = np.where(errors[np.arange(len(rest)), first] == 0, 0, (wrong & (RUN_OF[None, :] == first[:, None])).argmax(axis=1) - RUNS[first])
            rest = rest[(SLOTS[first] + left == slot) & (errors.sum(axis=1) <= DISTANCE)]
            mine = flat[start[x]:start[x + 1]]
            mark[mine] = True
            for y in rest:
                shared = int(mark[flat[start[y]:start[y + 1]]].sum())
                if 100 * shared >= percent * (length[x] + length[y] - shared) and root(int(component[x])) != root(int(component[y])):
                    joined[root(int(component[y]))] = root(int(component[x]))
                    found.append((rep[x], rep[y]))
            mark[mine] = False
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": np.int64, "b": np.int64})

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, star_rounds: int = 3,
) -> DataFrame:
    """Groups of documents that are linked by shingle sets with 100 * intersection >= percent * union.

    Returns id, n_shingles, component_id (smallest id reachable by links, the own included) and kept
    (id = component_id), one row per row of ``docs``.

    1. Texts with equal sets form one class; only its smallest id goes on, so copies cost nothing more.
    2. Signatures are joined on their index keys (see POSITIONS). No bucket is expanded to pairs: its
       smallest member is the centre, every class is compared with the centre that shares most buckets
       with it, links are confirmed on whole sets, and buckets that lie in one component are done.
    3. After ``star_rounds`` such rounds, or when one finds nothing, every pair that shares a bucket and still lies in
       different components is checked: first sizes and signature distance, then whole sets. Large buckets are compared by
       blocks, which give out links only. So each pair of signatures within DISTANCE is either confirmed, refuted or
       known to be connected.

    Null and empty texts have no set and are linked with nothing. A null id is linked with nothing; its
    component is null and the row is kept. Rows that share an id are one document that has all their texts.
    Other columns are not read. Jobs run when this is called."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # ids go through pandas as text, which has room for a null beside large numbers
    prepared = _prepared(given.withColumn("id", F.col("id").cast("string")), shingle_words).withColumn("id", F.col("id").cast("long"))
    prepared = settle(prepared, "near-prepared")
    given = given.where(F.col("id").isNotNull())
    named = settle_last(docs.sparkSession, lambda: _named(prepared, given, shingle_words, percent, star_rounds), "near-named")
    # rows without words match no class and stay their own component
    out = prepared.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _named(prepared: DataFrame, docs: DataFrame, size: int, percent: int, star_rounds: int) -> DataFrame:
    """(n, d1, d2, component_id) of every class of equal sets, by the steps of near_duplicates."""
    spark = docs.sparkSession
    classes = settle(
        prepared.where("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.min("sig").alias("sig")), "near-classes")
    keys = _keys(classes)
    shared = settle(keys.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("key", "centre"), "near-buckets")
    members = settle(keys.join(shared, "key").select("key", "rep", "centre"), "near-members")

    # a class may stand for several sets only if rows share an id; those are linked as they are
    links = settle(members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0), "near-links")
    tested = links
    groups = links.select(F.col("a").alias("rep"), F.col("b").alias("component"))
    for _ in range(star_rounds):
        crossing = _crossing(members, groups)
        offered = crossing.where("component <> m").groupBy("rep", "centre").agg(F.count("*").alias("n"))
        offered = offered.select(F.col("rep").alias("a"), F.col("centre").alias("b"), "n").join(tested, ["a", "b"], "left_anti")
        pairs = settle(offered.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")), "near-pairs")
        more = settle_last(spark, lambda: _confirmed(pairs, docs, size, percent), "near-found")  # noqa: B023
        if more.isEmpty():
            break
        tested = settle(tested.union(pairs), "near-tested")
        links = settle(links.union(more), "near-links")
        groups = _groups(links)

    crossing = settle(_crossing(members, groups).select("key", "rep", "component"), "near-crossing")
    shareable = settle_last(spark, lambda: _shareable(crossing, classes, docs, size, percent), "near-shareable")
    # a class has at most POSITIONS keys; they travel as one row, so that a group of near copies joins its classes, not their keys
    held = crossing.groupBy("rep").agg(F.first("component").alias("component"), F.collect_list("key").alias("keys"))
    sized = settle(held.join(shareable, "rep").select("rep", "component", "n", "c", F.explode("keys").alias("key")), "near-sized")
    buckets = sized.groupBy("key").agg(
        F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("component").alias("_m"), F.max("component").alias("_most"),
        F.bit_xor(F.xxhash64("rep")).alias("_d1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("_d2")).where("_m < _most")
    # of buckets with the same members the first by number has all their pairs
    buckets = buckets.groupBy("members", "_d1", "_d2").agg(F.first("shingles").alias("shingles"), F.min_by("key", F.expr(f"key & {POSITIONS - 1}")).alias("key"))
    sized = sized.join(settle(buckets.drop("_d1", "_d2"), "near-open"), "key")
    few = sized.where(F.col("members") <= FEW)
    other = few.select("key", F.col("rep").alias("b"), F.col("component").alias("other"), F.col("n").alias("n_b"), F.col("c").alias("c_b"))
    # at most the smaller set's shareable part is common; sets too unlike in size are out by the same measure
    common = F.least("c", "c_b")
    meet = few.join(other, "key").where("rep > b AND component <> other").where(100 * common >= percent * (F.col("n") + F.col("n_b") - common))
    pairs = settle(meet.select(F.col("rep").alias("a"), "b").distinct(), "near-pairs")
    both_ways = tested.union(tested.select("b", "a"))
    pairs = settle(_apart(pairs.join(both_ways, ["a", "b"], "left_anti"), classes), "near-pairs")
    more = settle_last(spark, lambda: _confirmed(pairs, docs, size, percent).union(
        _within_buckets(sized.where(F.col("members") > FEW), classes, docs, size, percent)), "near-found")
    if not more.isEmpty():
        groups = _groups(links.union(more))
    return classes.join(groups, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))


def _groups(links: DataFrame) -> DataFrame:
    return settle_last(links.sparkSession, lambda: components(links).select(F.col("node").alias("rep"), "component"), "near-groups")


def _crossing(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component, with the smallest component m and a centre in it."""
    now = members.drop("centre").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = now.groupBy("key").agg(F.min("component").alias("m"), F.max("component").alias("_most"), F.min_by("rep", "component").alias("centre"))
    return now.join(open_.where("m < _most").drop("_most"), "key")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the smallest id; columns as they came. Of repeated rows with one
    id all stay, as they are one document."""
    found = lambda: near_duplicates(docs, shingle_words=shingle_words, percent=percent)
    gone = settle_last(docs.sparkSession, lambda: found().where("NOT kept").select("doc_id").distinct(), "near-gone")
    return without(docs, "doc_id", gone, "doc_id")
