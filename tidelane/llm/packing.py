"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

#: Permitted sequence lengths in words.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: What opening a sequence costs beside its length, in words.
OPENING = 16.0
#: Documents that are packed together on average.
SHARD_DOCS = 4096
#: Equal rows that go to one shard together.
COPIES = 256
SCHEMA = "doc_id long, piece int, piece_words long, first_word long, bin_id string, bin_capacity int, bin_offset int, bin_words int"


def opening_size(length: int, filler: dict[int, float], capacities: tuple[int, ...], opening: float) -> int:
    """The capacity whose sequence costs least a word expected in it, ties to the smaller one.

    A sequence opened for ``length`` words at capacity c costs c + opening; of the c - length words left, it can
    expect to get filler[c]: what pieces still to come that fit there hold beyond the room of sequences open already.
    """
    return min((c for c in capacities if c >= length), key=lambda c: ((c + opening) / (length + min(c - length, filler[c])), c))


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, opening: float = OPENING) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, capacity of each bin) for pieces no longer than the largest capacity.

    Pieces go by falling length, ties by position, each to the open bin with the least room that holds it; if
    none does, a bin of ``opening_size`` opens. Short pieces are what fills the room of long ones, and they are
    promised once: while there are more of them than open room, a large capacity is cheapest; once they are
    all spoken for, a piece opens the capacity next to its length. At the end each bin shrinks to the smallest
    permitted capacity that holds its contents. Pieces of length 0 get bin -1.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [-lengths[i] for i in order]
    after = np.concatenate([np.cumsum([lengths[i] for i in reversed(order)], dtype=np.int64)[::-1], [0]])  # words of the pieces from each place on
    room: list[tuple[int, int]] = []  # (room, bin), rising
    used: list[int] = []
    spare = 0  # room of all open bins
    where, offset = [-1] * len(lengths), [0] * len(lengths)
    for at, i in enumerate(order):
        n = lengths[i]
        if n == 0:
            break
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            filler = {c: float(max(0, after[max(at + 1, bisect_left(falling, n - c))] - spare)) for c in capacities if c >= n}
            left, b = opening_size(n, filler, capacities, opening), len(used)
            used.append(0)
            spare += left
        where[i], offset[i] = b, used[b]
        used[b] += n
        spare -= n
        if left > n:
            insort(room, (left - n, b))
    return where, offset, [min(c for c in capacities if c >= u) for u in used]


def _pack_shard(capacities: tuple[int, ...], opening: float):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, top = key[0].as_py(), max(capacities)
        rows = sorted(zip(table["size"].to_pylist(), table["doc_id"].to_pylist(), table["copies"].to_pylist(), strict=True), key=lambda x: (x[1] is None, x[1] or 0, x[0], x[2]))
        ids, piece, length, first = [], [], [], []
        for size, doc in (x[:2] for x in rows for _ in range(x[2])):
            for p, start in enumerate(range(0, max(size, 1), top)):
                ids.append(doc)
                piece.append(p)
                first.append(start)
                length.append(min(top, size - start))
        where, offset, capacity = best_fit(length, capacities, opening)
        used = np.zeros(len(capacity) + 1, dtype=np.int64)
        np.add.at(used, where, length)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "piece": pa.array(piece, pa.int32()),
                "piece_words": pa.array(length, pa.int64()),
                "first_word": pa.array(first, pa.int64()),
                "bin_id": pa.array([f"{shard}-{b}" if b >= 0 else None for b in where], pa.string()),
                "bin_capacity": pa.array([capacity[b] if b >= 0 else None for b in where], pa.int32()),
                "bin_offset": pa.array([offset[i] if b >= 0 else None for i, b in enumerate(where)], pa.int32()),
                "bin_words": pa.array([used[b] if b >= 0 else None for b in where], pa.int32()),
            }
        )

    return pack


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, opening: float = OPENING, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack whole ``docs`` (doc_id, text): a row for each piece, with the bin that holds it.

    A document longer than the largest capacity is cut into pieces of that many words and a rest. Equal rows are
    counted first, and COPIES of them at most go together. Documents
    are dealt to shards by a hash of id, size and number, ``shard_docs`` each on average, and a shard is packed by
    itself, so memory is bounded and bins never mix shards. Null and empty texts give one piece of 0 words in
    no bin (null). Repeated rows are packed as often as they come; order among equal rows is immaterial. The
    empty table gives no rows. Other columns are not read.
    """
    sizes = docs.select("doc_id", word_count(F.col("text")).alias("size"))
    shards = max(1, -(-docs.count() // shard_docs))
    sizes = sizes.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    sizes = sizes.select("doc_id", "size", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}"))).alias("part"))
    sizes = sizes.select("doc_id", "size", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("int").alias("copies"), "part")
    sizes = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "part"), F.lit(shards)).cast("int"))
    return sizes.groupBy("shard").applyInArrow(_pack_shard(tuple(sorted(capacities)), opening), SCHEMA)
