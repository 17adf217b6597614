"""Best-fit packing of documents into sequences of a fixed length.

Documents longer than a sequence are cut into pieces.  Each task packs its own
share of the pieces: rows are dealt out evenly, without a key, so no source or
group of copies can fill a task, and ``PIECES_PER_TASK`` bounds what a task holds.

In a task, pieces come in order of falling length.  Bins are kept in order of
what is left in them, each with a bitmap of the sources and one of the duplicate
clusters it holds.  A piece looks for the first bin that has room, the tightest,
and goes on from bin to bin until one holds neither its source nor its cluster;
if none does, it opens a new one.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 16_384
PIECES_PER_TASK = 8_000


def bits(values: list) -> list[int]:
    """A one-bit number per value; 0 for null and for values that occur once, which conflict with nothing."""
    count = Counter(values)
    place = {v: i for i, v in enumerate(v for v in count if v is not None and count[v] > 1)}
    return [1 << place[v] if v in place else 0 for v in values]


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece; pieces come in the order in which they are to be packed."""
    source, cluster = bits(sources), bits(clusters)
    held_source: list[int] = []
    held_cluster: list[int] = []
    open_bins: list[tuple[int, int]] = []  # (what is left, bin), in order
    chosen = []
    for i, length in enumerate(lengths):
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (held_source[b] & source[i] or held_cluster[b] & cluster[i]):
                break
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(held_source)
            held_source.append(0)
            held_cluster.append(0)
        held_source[b] |= source[i]
        held_cluster[b] |= cluster[i]
        insort(open_bins, (left - length, b))
        chosen.append(b)
    return chosen


def _pack_share(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if share is None or not share.num_rows:
            return
        share = share.sort_by([("length", "descending"), ("doc_id", "ascending"), ("part", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        share = share.combine_chunks()
        chosen = pack(*(share.column(c).to_pylist() for c in ("length", "source", "cluster")), capacity)
        task = TaskContext.get().partitionId()
        placed, room, slots, begins = Counter(), Counter(), [], []
        for b, length in zip(chosen, share.column("length").to_pylist(), strict=True):
            slots.append(placed[b])
            begins.append(room[b])
            placed[b] += 1
            room[b] += length
        columns = {
            "bin_id": pa.array([(task << 32) + b for b in chosen], pa.int64()), "slot": pa.array(slots, pa.int32()),
            "at": pa.array(begins, pa.int32()), **{c: share.column(c) for c in ("doc_id", "part", "start", "length", "source", "cluster")},
        }
        yield from pa.table(columns).to_batches()

    return run


def _whole(length: str | None) -> Column:
    return F.coalesce(F.length(F.col("text").cast("string")) if length is None else F.col(f"`{length}`").cast("int"), F.lit(0))


def pieces(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, length: str | None = None) -> DataFrame:
    """``(doc_id, part, start, length, source, cluster)``: each text in pieces of at most ``capacity`` code points.

    A null or empty text is one piece of length 0.  Without a column ``cluster``,
    equal texts form a cluster.  A column ``length`` stands for the text's length in code points.
    """
    text = F.col("text").cast("string")
    group = F.when(F.length(text) > 0, F.xxhash64(text)) if cluster is None else F.col(f"`{cluster}`").cast("long")
    measured = docs.select(F.col("doc_id").cast("long"), _whole(length).alias("whole"), F.col("source").cast("string"), group.alias("cluster"))
    last = F.greatest(F.ceil(F.col("whole") / capacity).cast("int") - 1, F.lit(0))
    cut = measured.select("doc_id", "whole", "source", "cluster", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part") * capacity
    return cut.select(
        "doc_id", "part", start.alias("start"), F.least(F.col("whole") - start, F.lit(capacity)).cast("int").alias("length"), "source", "cluster"
    )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, per_task: int = PIECES_PER_TASK, length: str | None = None
) -> DataFrame:
    """Packed sequences of ``docs(doc_id, text, source)``, one row per piece.

    ``(bin_id, slot, at, doc_id, part, start, length, source, cluster)``: the piece is the
    ``length`` code points of the document from ``start`` on (0-based), and stands at
    ``at`` in the sequence.  Every piece of every row is in exactly one bin; a bin
    holds at most ``capacity`` code points, and neither a source nor a cluster
    twice.  A null source or cluster conflicts with nothing.  Rows that repeat are
    packed each, in different bins.  Other columns are ignored.
    """
    cut = pieces(docs, capacity, cluster, length)
    count = docs.agg(F.sum(F.greatest(F.ceil(_whole(length) / capacity), F.lit(1)))).first()[0] or 0
    return cut.repartition(max(1, -(-int(count) // per_task))).mapInArrow(
        _pack_share(capacity),
        "bin_id long, slot int, at int, doc_id long, part int, start int, length int, source string, cluster long",
    )
