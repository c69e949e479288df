"""Packing of tokenised documents by concatenation: one stream of ids, cut at fixed places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.llm.packing import token_ids
from voxrisk.session import settle

CAPACITY = 2048
END_ID = 1
PARTS_PER_BLOCK = 1024  # partitions whose totals are summed up together
ID_BYTES = 4


def tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """(id, part, place, n, ids): a document's ids and ``end_id`` as little-endian 32-bit numbers, the partition that read it, and
    how many ids of that partition stand before it. A task numbers its rows itself, so these hold once the rows are written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.append(token_ids(text or "", vocabulary), np.uint32(end_id)).astype("<u4") for text in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            columns = [batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(places), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "place", "n", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(read, f"id {kind}, part long, place long, n long, ids binary")


def partition_offsets(totals: DataFrame) -> DataFrame:
    """(part, base): ids in all partitions before, from (part, total).

    Blocks of PARTS_PER_BLOCK partitions are summed first, then the partitions inside each block: one task only ever
    sees a row per block, a thousand for a million partitions."""
    placed = totals.withColumn("block", F.floor(F.col("part") / PARTS_PER_BLOCK))
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("total").over(before(Window.orderBy("block"))), F.lit(0))
    blocks = placed.groupBy("block").agg(F.sum("total").alias("total")).select("block", upto.alias("of_block"))
    inside = F.coalesce(F.sum("total").over(before(Window.partitionBy("block").orderBy("part"))), F.lit(0))
    return placed.select("part", "block", inside.alias("in_block")).join(blocks, "block").select("part", (F.col("of_block") + F.col("in_block")).alias("base"))


def last_windows(total: int, capacity: int) -> list[tuple[int, int, int]]:
    """(first place, length, number) of the windows of what is left after the full ones: powers of two, the largest first, so that
    none has to be padded."""
    at, number, out = total // capacity * capacity, total // capacity, []
    while at < total:
        length = 1 << (total - at).bit_length() - 1
        out.append((at, length, number))
        at, number = at + length, number + 1
    return out


def pack_concatenated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Concatenate all documents, each its ids and ``end_id``, and cut the stream every ``capacity`` ids.

    The first pass writes the ids with their place in their partition. Partition totals, summed up in two steps, give every document
    its place in the whole stream. The second pass cuts each document at the window boundaries that it meets: one record per
    document and window, so a window's records may come from several partitions. All windows are full but those of the last
    ``total % capacity`` ids, whose lengths are powers of two. Nothing is sorted or grouped by document.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece. Null and empty texts are ``end_id`` alone.
    Null ids and repeated rows are packed like all others, each row as a document of its own; other columns are not read. An
    empty table gives no rows. A document's ids have to fit in one Spark value: 500 million. Jobs run when this is called."""
    tokens = settle(tokenized(docs, id_col, text_col, vocabulary, end_id), "concat-tokens")
    bases = settle(partition_offsets(tokens.groupBy("part").agg(F.sum("n").alias("total"))), "concat-bases")
    total = tokens.agg(F.sum("n")).first()[0] or 0

    full = total // capacity
    begin, end = F.col("base") + F.col("place"), F.col("base") + F.col("place") + F.col("n")
    first, last = F.floor(F.col("begin") / capacity), F.least(F.floor((F.col("end") - 1) / capacity), F.lit(full - 1))
    window = lambda at, length, number: F.struct(at.cast("bigint").alias("at"), length.cast("bigint").alias("length"), number.cast("bigint").alias("number"))
    whole = F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), lambda w: window(w * capacity, F.lit(capacity), w))
    rest = F.array(*[window(*map(F.lit, x)) for x in last_windows(total, capacity)]).cast("array<struct<at:bigint,length:bigint,number:bigint>>")
    met = F.concat(whole, F.filter(rest, lambda w: (w["at"] < F.col("end")) & (w["at"] + w["length"] > F.col("begin"))))

    def piece(w):
        start = F.greatest(w["at"], F.col("begin")) - F.col("begin")
        length = F.least(w["at"] + w["length"], F.col("end")) - F.col("begin") - start
        cut = F.substring(F.col("ids"), (start * ID_BYTES + 1).cast("int"), (length * ID_BYTES).cast("int"))
        return F.struct(
            start.alias("start"), length.alias("length"), F.crc32(cut).alias("ids_crc32"), F.col("n").alias("doc_tokens"), w["number"].alias("sequence_id"),
            (F.col("begin") + start - w["at"]).alias("offset"))

    placed = tokens.join(bases, "part").select("id", "n", "ids", begin.alias("begin"), end.alias("end"))
    return placed.select(F.col("id").alias(id_col), F.inline(F.transform(met, piece)))
