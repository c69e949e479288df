"""Packing of tokenised documents into sequences: best fit, then swap-based local search."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.session import settle

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs together. A block leaves about one sequence badly filled, and the next level packs those.
BLOCK_PIECES = 16_384
#: Pairs of underfull sequences that the local search of a block looks at, at most.
SEARCH_PAIRS = 20_000
LOOSE = 0.95  # sequences filled less are taken apart and packed again on the next level
LEVEL_GAIN = 0.01  # a level that saves a smaller share of the sequences it took apart is the last


@cache
def _encoder(vocabulary: str):
    """Byte-level BPE over the ranks of the public vocabulary; ids are those of the same vocabulary as JSON."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@cache
def _patient_encoder(vocabulary: str):
    """The same vocabulary as JSON: slower, but without a limit on runs of white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary + ".json"))


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    try:
        ids = _encoder(vocabulary).encode(text, allowed_special="all")
    except ValueError:  # its pattern gives up on about a million white-space characters in a row
        ids = _patient_encoder(vocabulary).encode(text, add_special_tokens=False).ids
    return np.array(ids, np.uint32)


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document, its ids followed by ``end_id``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, ids_of = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", vocabulary), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start:first if piece == 0 else start + capacity]
                    at.append(i)
                    rows.append((piece, start, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_of.append(part.astype(np.int32))
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers[:, 0], pa.int32()), *(pa.array(numbers[:, k], pa.int64()) for k in (1, 2, 3))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_of, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(read, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions, longest first, each into the fullest bin that has room. Bins by free space are found in a bit set."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        room = spaces >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        if space > size:
            by_space[space - size].append(b)
            spaces |= 1 << (space - size)
    return bins


def _exchange(a: list[int], b: list[int], gap: int, size: list[int]) -> tuple[int, list[int], list[int]] | None:
    """What to take from bin a and from bin b so that a, which has ``gap`` free, gains most: (gain, from a, from b).

    From b to a goes one document, or one or two against one, or one against two."""
    best: tuple[int, list[int], list[int]] | None = None

    def offer(gain: int, out: list[int], into: list[int]) -> None:
        nonlocal best
        if 0 < gain <= gap and (best is None or gain > best[0]):
            best = (gain, out, into)

    ones_a, ones_b = [(size[i], [i]) for i in a], [(size[j], [j]) for j in b]
    pairs = lambda x: [(size[x[i]] + size[x[j]], [x[i], x[j]]) for i in range(len(x)) for j in range(i)]
    for s, into in ones_b:
        offer(s, [], into)
    for more_b, less_a in ((ones_b, ones_a), (pairs(b), ones_a), (ones_b, pairs(a))):
        have = sorted(less_a, key=lambda x: x[0])
        sums = [x[0] for x in have]
        for s, into in more_b:
            k = bisect_left(sums, s - gap)  # the smallest that may be given for s gains most
            if k < len(have):
                offer(s - have[k][0], have[k][1], into)
        if best and best[0] == gap:
            break
    return best


def local_search(bins: list[list[int]], size: list[int], capacity: int, pairs: int = SEARCH_PAIRS) -> list[list[int]]:
    """Empty bins by exchanges between underfull ones.

    Every exchange moves tokens from the emptier bin of a pair to the fuller, so the sum of squared fills grows and the
    search ends; a bin that runs empty is gone. It stops when the count reaches the bound given by the total, when
    no exchange is left, or after looking at ``pairs`` pairs; documents are only ever moved, so any stop is a packing."""
    bound = -(-sum(size) // capacity)
    fill = [sum(size[i] for i in b) for b in bins]
    left, looked, moved = len(bins), 0, True
    while moved and left > bound and looked < pairs:
        moved = False
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        # the emptiest give what they have, first where the gap is wide; stripped to few small documents, they then fill one another
        for low in under[:2 * (left - bound) + 2]:
            gave = True
            while gave and fill[low] and looked < pairs:
                gave = False
                for high in under:
                    if high == low or fill[high] < fill[low] or fill[high] == capacity or not fill[high]:
                        continue
                    looked += 1
                    found = _exchange(bins[high], bins[low], capacity - fill[high], size)
                    if found:
                        gain, out, into = found
                        bins[high] = [i for i in bins[high] if i not in out] + into
                        bins[low] = [i for i in bins[low] if i not in into] + out
                        fill[high], fill[low], gave, moved = fill[high] + gain, fill[low] - gain, True, True
                    if not fill[low] or looked >= pairs:
                        break
            left -= not fill[low]
    return [b for b in bins if b]


def pack_lengths(size: list[int], capacity: int, pairs: int = SEARCH_PAIRS) -> list[list[int]]:
    return local_search(best_fit(size, capacity), size, capacity, pairs)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = END_ID,
    block_pieces: int = BLOCK_PIECES, with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``. One longer than a sequence is cut into whole sequences, its first piece taking the
    remainder. Pieces are dealt by hash into blocks of about ``block_pieces``, each packed by one task; sequences filled to less than
    LOOSE are then dealt anew into blocks of that size and packed again, until one block is left or a level saves less than LEVEL_GAIN
    of them: pieces that don't combine among so many don't combine among others either. No level packs more than about
    ``block_pieces`` together, whatever the ids and lengths. Returns id, piece, start, length, ids_crc32, sequence_id, offset and,
    if asked for, ids.

    Null and empty texts are a piece with ``end_id`` alone. Null ids and repeated rows are packed like all others; other
    columns are not read. An empty table gives no rows. Jobs run when this is called."""
    kind = docs.schema[id_col].dataType
    # ids go through pandas as text, which has room for a null beside large numbers
    named = docs.select(F.col(id_col).cast("string").alias(id_col), text_col)
    pieces = settle(tokenized_pieces(named, id_col, text_col, vocabulary, capacity, end_id, with_ids), "pack-pieces")
    columns = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", block int, bin int, offset long, fill long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["length"].tolist()
        bins = pack_lengths(size, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(size))
        counts = np.array([len(b) for b in bins])
        out = rows.iloc[order].copy()
        out["bin"] = np.repeat(np.arange(len(bins)), counts)
        ends = out.groupby("bin")["length"].cumsum()
        out["offset"] = ends - out["length"]
        out["fill"] = ends.groupby(out["bin"]).transform("max")
        return out

    todo, level, done = pieces, 0, None
    n, taken = pieces.count(), None
    while True:
        blocks = max(1, -(-n // block_pieces))
        # rows may be alike in all columns, so their places in the table spread them
        spread = F.xxhash64("id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id(), F.lit(level))
        dealt = todo.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
        packed = settle(dealt.groupBy("block").applyInPandas(pack, schema), "pack-level")
        number = (F.lit(level).cast("bigint") * (1 << 56) + F.col("block").cast("bigint") * (1 << 24) + F.col("bin")).alias("sequence_id")
        loose = F.col("fill") < LOOSE * capacity
        first = F.col("offset") == 0  # one piece of each sequence
        made, again, n = packed.agg(F.count_if(first), F.count_if(first & loose), F.count_if(loose)).first()
        last = blocks == 1 or again == 0 or (taken is not None and taken - made < LEVEL_GAIN * taken)
        kept = (packed if last else packed.where(~loose)).select(*columns, number, "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
        todo, taken, level = packed.where(loose).select(*columns), again, level + 1
