"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once.  A sequence of c tokens costs
``c + c * c / QUADRATIC + OVERHEAD``: the linear part, attention, and the fixed work of a sequence.
Long bins fill better, short ones cost less a token, so the lengths are chosen jointly for each
block of items: a plan says which length an item opens, by the smallest permitted length that holds
it, and the plan of least total cost is sought by packing the block under the plans that differ in
one place from the best so far, until none is better; it starts from the best single length.  Under a
plan, items are placed largest first into the open bin that they fill best, whatever its length;
if none has room, the plan's bin is opened; at the end each bin is downsized to the smallest
permitted length that holds its contents.  Documents longer than the largest length are cut into
pieces of that length and a rest; nothing is dropped.

Blocks: rows go to blocks of about BLOCK rows by a hash of doc_id and text, so the result depends
on the rows and not on how they are split over files or tasks.  Only (doc_id, a hash of the text,
length, carried columns) are shuffled; equal rows are counted before the shuffle and their copies
spread over blocks, so no row that repeats fills one task.  Lengths are counts of words and signs,
or whatever column ``length`` gives.

Defined results: null or empty text (length 0): one row without a bin (null) and of length 0;
very long texts: several rows; repeated rows are packed each; ties: larger item first, then
doc_id (null first), hash of the text, copy, piece; among bins that leave as much room, the oldest; of
plans of the same cost the first tried; an empty table: no rows; other columns are ignored, or
carried under any name but the result's own, which is an error that names the column.  Carried
columns must be of types that can be grouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brineloom.llm.shared import partitions

CAPACITIES = (512, 1024, 2048, 4096)
#: Tokens at which attention costs as much as the rest of the model (six times a width of 1024).
QUADRATIC = 6144
#: The fixed work of one sequence, in tokens.
OVERHEAD = 32
#: Rows of a block, on average; copies of one row go to other blocks after so many.
BLOCK, COPIES = 16_384, 1024
RESULT = ("doc_id", "text_key", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset")


def word_count(text: Column) -> Column:
    """Words and signs: runs of letters and digits, and single other characters but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(0)).cast("long")


def cost(capacity: float) -> float:
    return capacity + capacity * capacity / QUADRATIC + OVERHEAD


def pieces(lengths: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, length) after cutting; rows of length 0 have none."""
    n = -(-lengths // largest)
    row = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return row, piece, np.minimum(lengths[row] - piece * largest, largest)


def best_fit(sizes: np.ndarray, plan, capacities=CAPACITIES) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each item, given in the order of placing, and each bin's length.

    plan: for each permitted length in order, what the items open that it is the smallest to hold.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    capacities = sorted(capacities)
    opens = np.array(plan)[np.searchsorted(capacities, sizes)].tolist()
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # bins by room left, oldest last
    have = 0  # bit r: some bin has room r
    for i, size in enumerate(sizes.tolist()):
        larger = have >> size
        if larger:
            r = size + (larger & -larger).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                have &= ~(1 << r)
        else:
            b, r = len(used), opens[i]
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if r > size:
            left = r - size
            stack = room[left]
            stack.append(b)
            if len(stack) > 1 and stack[-2] < b:  # oldest last: pop() takes the oldest
                stack.sort(reverse=True) if len(stack) < 8 else stack.insert(0, stack.pop())
            have |= 1 << left
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def total(lengths: list[int]) -> float:
    return sum(map(cost, lengths))


def joint(sizes: np.ndarray, capacities=CAPACITIES):
    """The plan of least cost found, and its packing (bin, offset, lengths); sizes largest first."""
    caps = tuple(sorted(capacities))
    tried: dict[tuple[int, ...], tuple] = {}

    def packed(plan):
        if plan not in tried:
            got = best_fit(sizes, plan, caps)
            tried[plan] = (total(got[2]), got)
        return tried[plan][0]

    single = [tuple(max(c, own) for own in caps) for c in caps]
    best = min(single, key=packed)
    while True:
        near = [(*best[:i], c, *best[i + 1 :]) for i, own in enumerate(caps) for c in caps if c >= own and c != best[i]]
        nxt = min(near, key=packed, default=best)
        if packed(nxt) >= packed(best):
            return best, tried[best][1]
        best = nxt


def pack(docs: DataFrame, carry=(), length: Column | None = None, capacities=CAPACITIES) -> DataFrame:
    """One row a piece: (doc_id, carry..., text_key, piece, start, length, bin_id, bin_capacity, bin_offset).

    text_key: xxhash64 of the text, which with doc_id tells rows apart; start: of the piece in its
    document; bin_offset: of the piece in its bin; both in tokens.
    """
    if clash := [c for c in carry if c.startswith("__") or c in RESULT]:
        raise ValueError(f"rename before packing: {clash}")
    length = word_count(F.col("text")) if length is None else length
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), length.cast("long").alias("__length"), *carry)
    source = source.groupBy(*source.columns).agg(F.count("*").alias("__copies"))
    source = source.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(COPIES).cast("long"))))
    source = source.withColumn("__copies", F.least(F.lit(COPIES).cast("long"), F.col("__copies") - F.col("__from")))
    rows = docs.count()
    blocks = max(1, -(-rows // BLOCK))
    source = source.withColumn("__block", F.pmod(F.xxhash64("doc_id", "text_key", "__from"), F.lit(blocks)))
    kept = [f for f in source.schema.fields if f.name in carry]
    names = ["doc_id", *(f.name for f in kept), *RESULT[1:]]
    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text_key long, piece int, start long, length long, bin_id string, bin_capacity int, bin_offset long"])
    largest = max(capacities)

    def run(key, table):
        table = table.combine_chunks()
        copies = table.column("__copies").to_numpy()
        of = np.repeat(np.arange(table.num_rows), copies)
        copy = np.arange(len(of)) - np.repeat(np.cumsum(copies) - copies, copies) + table.column("__from").to_numpy()[of]
        sizes = np.maximum(table.column("__length").fill_null(0).to_numpy(), 0)[of]
        row, piece, size = pieces(sizes, largest)
        ids, valid = table.column("doc_id").fill_null(0).to_numpy()[of], table.column("doc_id").is_valid().to_numpy()[of]
        text = table.column("text_key").to_numpy()[of]
        order = np.lexsort((piece, copy[row], text[row], ids[row], valid[row], -size))
        _, (where, offset, capacity) = joint(size[order], capacities)
        empty = np.flatnonzero(sizes == 0)
        bin_names = np.array([f"{key[0].as_py()}-{b}" for b in range(len(capacity))], dtype=object)
        cap = np.array(capacity, np.int32)
        take = table.take(pa.array(of[np.concatenate([row[order], empty])]))
        zero, blank = np.zeros(len(empty), np.int64), [None] * len(empty)
        ends = [pa.array(np.append(piece[order], zero), pa.int32()), pa.array(np.append(piece[order] * largest, zero), pa.int64()), pa.array(np.append(size[order], zero), pa.int64())]
        ends += [pa.array([*bin_names[where], *blank], pa.string()), pa.array([*cap[where].tolist(), *blank], pa.int32()), pa.array([*offset.tolist(), *blank], pa.int64())]
        return pa.table([take.column("doc_id"), *(take.column(f.name) for f in kept), take.column("text_key"), *ends], names=names)

    return source.repartition(partitions(docs.sparkSession), "__block").groupBy("__block").applyInArrow(run, schema)


def op6(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: where each document (or piece) goes; nulls, ties and all else as in ``pack``."""
    return pack(docs)


QUERIES = {"op6_best_fit_packing": op6}
ORACLE: dict[str, str] = {}
