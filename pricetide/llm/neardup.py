"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

A sketch has ``t`` coordinates.  In round i each shingle of a document is
thrown into one coordinate by a hash of that round, and a coordinate that was
empty before the round keeps its smallest hash; rounds ``t .. 2t-1`` throw
everything into coordinate ``i - t``, so no coordinate stays empty.  Two
documents agree in a coordinate with a probability of their Jaccard
similarity, with concentration as of a full MinHash, for one pass over a long
document instead of ``t``.

Only distinct shingle sets take part, so exact copies cost one row each.  Sets
that agree in a whole band are candidates:

1. each set is checked against the hubs it shares most bands with (the hub of a
   band's bucket is its member with most fellow members over all buckets);
2. components are formed, and within a bucket all pairs that are still in
   different components are checked, whatever their number: in small buckets
   by a join, in crowded ones by comparing blocks of sets, of which only
   confirmed links leave the task.

Every link is confirmed on the full sets.  Components, not pairs, are asked
for, so pairs inside a component need no check.

With 40 bands of 5 coordinates a pair at similarity 0.8 is missed with
probability 1.3e-7, and less above.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import keep
from pricetide.llm.components import components
from pricetide.llm.words import U, blocks, mix, shingle_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 5
BANDS = 40
BAND_ROWS = 5
HUBS = 3
#: Text whose sets are made and sketched together, about.
BLOCK_BYTES = 1 << 20
#: Sets in buckets up to this size meet in a join; larger buckets are compared in blocks of sets.
SMALL_BUCKET = 32
BLOCK_SETS = 1_024
BLOCK_SHINGLES = 1_000_000
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of ``t`` coordinates per non-empty set."""
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    doc = np.repeat(np.arange(len(sets)), sizes)
    item = np.concatenate(sets) if sets else np.zeros(0, U)
    empty = np.iinfo(U).max
    cells = np.full(len(sets) * t, empty, U)
    open_sets = np.arange(len(sets))  # those with an empty coordinate; most are full after a few rounds
    for turn in range(2 * t):
        if not len(item):
            break
        thrown = mix(item + U((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        if turn < t:
            cell = doc * t + (((thrown >> U(32)) * U(t)) >> U(32)).astype(np.int64)
        else:
            cell = doc * t + (turn - t)
        free = cells[cell] == empty
        # the largest hash marks a free cell, so it counts as the one below it
        np.minimum.at(cells, cell[free], np.minimum(mix(thrown[free]), U(empty - 1)))
        unfilled = (cells.reshape(len(sets), t)[open_sets] == empty).any(axis=1)
        if not unfilled.all():
            open_sets = open_sets[unfilled]
            still = np.isin(doc, open_sets)
            doc, item = doc[still], item[still]
    return cells.reshape(len(sets), t)


def _signatures(k: int, bands: int, rows: int):
    salts = mix(np.arange(1, bands + 1, dtype=U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, encoded in blocks(texts, BLOCK_BYTES):
                sets = shingle_sets(encoded, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                keys = np.zeros((len(sets), 2), np.int64)
                if full:
                    items, begins = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                    for side, salt in enumerate((U(0), U(0xA5A5A5A5A5A5A5A5))):
                        keys[sizes > 0, side] = np.add.reduceat(mix(items ^ salt), begins).view(np.int64)
                cells = sketches(full, bands * rows).reshape(len(full), bands, rows)
                bucket = np.broadcast_to(salts, cells.shape[:2])
                for row in range(rows):
                    bucket = mix(bucket * U(0x9E3779B97F4A7C15) + cells[:, :, row])
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(encoded)), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(bucket).view(np.int64).ravel())
                        ),
                        *(c.slice(start, len(encoded)) for c in batch.columns[2:]),
                    ],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "buckets", *batch.schema.names[2:]],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of rows that repeat, one a task is enough
        for batch in batches:
            ids, keys, often, texts = (batch.column(i).to_pylist() for i in range(4))
            for start, encoded in blocks(texts, BLOCK_BYTES):
                out = []
                for i, s in enumerate(shingle_sets(encoded, k), start):
                    if int(mix(s).sum(dtype=U).view(np.int64)) != keys[i] or (ids[i], keys[i]) in seen:
                        continue  # an id may repeat with another text; only the set in question counts
                    if often[i]:
                        seen.add((ids[i], keys[i]))
                    out.append((ids[i], len(s), s.tobytes(), keys[i], often[i]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.int64()),
                        pa.array([x[4] for x in out], pa.bool_()),
                    ],
                    names=["rep", "n", "shingles", "key_a", "often"],
                )

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), U)
                b = np.frombuffer(right[i].as_buffer(), U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right one."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out.astype(np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    known = np.intersect1d(a, b)
    if not len(known):
        return out.astype(np.int64)

    def placed(items: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(known, items).clip(max=len(known) - 1)
        hit = known[at] == items
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    (at_a, row_a), (at_b, row_b) = placed(a, row_a), placed(b, row_b)
    in_a, in_b = np.bincount(at_a, minlength=len(known)), np.bincount(at_b, minlength=len(known))
    frequent = in_a * in_b > len(left) * len(right) / 64
    # frequent shingles by matrix products, a slice of columns at a time
    column = np.cumsum(frequent) - 1
    use_a, use_b = frequent[at_a], frequent[at_b]
    for low in range(0, int(frequent.sum()), 2048):
        x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        for dense, at, rows, use in ((x, at_a, row_a, use_a), (y, at_b, row_b, use_b)):
            part = use & (column[at] >= low) & (column[at] < low + 2048)
            dense[rows[part], column[at[part]] - low] = 1
        out += x @ y.T
    # the others by listing who meets whom, a bounded number of meetings at a time
    first_b = np.cumsum(in_b) - in_b
    rare_at, rare_row = at_a[~use_a], row_a[~use_a]
    meetings = np.cumsum(in_b[rare_at]) if len(rare_at) else np.zeros(0, np.int64)
    start = 0
    while start < len(rare_at):
        stop = max(start + 1, int(np.searchsorted(meetings, (meetings[start - 1] if start else 0) + 4_000_000, side="right")))
        at, count = rare_at[start:stop], in_b[rare_at[start:stop]]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        pair = np.repeat(rare_row[start:stop], count) * len(right) + row_b[np.repeat(first_b[at], count) + within]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape)
        start = stop
    return out.astype(np.int64)


def _block_links(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), U) for x in rows.column("shingles")]
        rep, component, block = (rows.column(c).to_numpy() for c in ("rep", "component", "block"))
        low, high = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        names, count = np.unique(component, return_counts=True)
        main = component == names[count.argmax()]
        found: set[tuple[int, int]] = set()
        # pairs inside the largest component need no check
        for left, right in (((block == low) & ~main, block == high), ((block == low) & main, (block == high) & ~main)):
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            for start in range(0, len(a), 512):
                part = a[start : start + 512]
                both = overlaps([sets[x] for x in part], [sets[x] for x in b])
                size_a, size_b = np.array([len(sets[x]) for x in part]), np.array([len(sets[x]) for x in b], np.int64)
                near = 100 * both >= percent * (size_a[:, None] + size_b[None, :] - both)
                near &= component[part][:, None] != component[b][None, :]
                for x, y in zip(*np.nonzero(near), strict=True):
                    found.add(tuple(sorted((int(rep[part[x]]), int(rep[b[y]])))))
        pairs = sorted(found)
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; sizes alone rule many out before the sets are read."""
    with_u = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su")), "u")
    with_both = with_u.join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv")), "v")
    return with_both.select("u", "v", "su", "sv").mapInArrow(_confirmed(percent), "u long, v long")


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS, carry: str | None = None
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Words are runs of non-blank characters with A-Z lower-cased.  A text with
    fewer than ``k`` words has its whole sequence as the only shingle.  A text
    that is null or has no word has an empty set and is linked with nothing.  Each
    row is judged by its own text, also where an id repeats; a row with a null id
    is linked with nothing.  Of equal rows all are kept or none.  The column
    ``carry``, if given, passes through; others are ignored.
    """
    passed = [carry] if carry else []
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in passed)
    signed = keep(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *passed).mapInArrow(
            _signatures(k, bands, rows), "doc_id long, n_shingles long, key_a long, key_b long, buckets array<long>" + more
        )
    )
    key = ["n_shingles", "key_a", "key_b"]
    usable = signed.where("doc_id is not null and n_shingles > 0")
    first = usable.groupBy(key).agg(F.min("doc_id").alias("rep"))
    # one row per distinct set: its smallest id stands for it
    lead = usable.join(first.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"]).dropDuplicates([*key, "doc_id"])
    placed = lead.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("fellows")).where("fellows > 1")
    member = keep(placed.join(shared, "bucket"))

    standing = member.groupBy("rep").agg(F.sum("fellows").alias("standing"))
    known = member.select("bucket", "rep", "n").join(standing, "rep")
    hubs = known.groupBy("bucket").agg(F.max(F.struct("standing", (-F.col("rep")).alias("low"), "n")).alias("hub"))
    meets = (
        known.select("bucket", "rep", "n")
        .join(hubs.select("bucket", (-F.col("hub.low")).alias("hub"), F.col("hub.n").alias("hub_n")), "bucket")
        .where("rep <> hub")
        .where(_sizes_allow("n", "hub_n", percent))
        .groupBy("rep", "hub")
        .agg(F.count("*").alias("bands"))
    )
    order = Window.partitionBy("rep").orderBy(F.desc("bands"), "hub")
    best = meets.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= HUBS)
    # only sets in a bucket with another set are ever compared
    often = keep(usable.groupBy(F.col("doc_id").alias("rep")).agg((F.count("*") > 1).alias("often")).where("often"))
    wanted = member.select("rep").distinct().join(first.select("rep", "key_a"), "rep").join(often, "rep", "left")
    read = keep(
        docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
        .join(wanted, "rep")
        .select("rep", "key_a", F.coalesce("often", F.lit(False)).alias("often"), "text")
        .mapInArrow(_full_sets(k), "rep long, n long, shingles binary, key_a long, often boolean")
    )
    sets = read.select("rep", "n", "shingles")
    if not often.isEmpty():
        sets = keep(read.where("not often").union(read.where("often").dropDuplicates(["rep", "key_a"])).select("rep", "n", "shingles"))
    links = keep(_links(best.select(F.col("rep").alias("u"), F.col("hub").alias("v")), sets, percent))
    found = components(links)

    # whatever shares a bucket but not yet a component
    labelled = keep(
        member.select("bucket", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
            "bucket", "rep", "n", F.coalesce("component", "rep").alias("component")
        )
    )
    mixed = keep(
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.min("rep").alias("low"))
        .where("x <> y")
        .select("bucket", "size", "low")
    )
    few = labelled.join(mixed.where(F.col("size") <= SMALL_BUCKET).select("bucket"), "bucket")
    mine, other = few.alias("mine"), few.alias("other")
    pairs = (
        mine.join(other, F.col("mine.bucket") == F.col("other.bucket"))
        .where(F.col("mine.component") < F.col("other.component"))
        .where(_sizes_allow("mine.n", "other.n", percent))
        .select(F.col("mine.rep").alias("u"), F.col("other.rep").alias("v"))
        .distinct()
    )
    crowd = keep(labelled.join(mixed.where(F.col("size") > SMALL_BUCKET).select("bucket", "low"), "bucket").select("rep", "n", "component", "low"))
    more = keep(_links(pairs, sets, percent).union(_crowded_links(crowd, sets, percent)))
    if not more.isEmpty():
        found = components(links.union(more))

    label = first.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component_id")
    )
    with_label = signed.select("doc_id", *key, *passed).join(label, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return with_label.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        *passed,
    )


def row_key() -> Column:
    """What tells the rows of ``docs(doc_id, text)`` apart: the same for rows with equal id and text, null ids included."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def groups(docs: DataFrame, *carry: Column | str) -> DataFrame:
    """The columns ``carry`` of every row of ``docs(doc_id, text)``, with ``row_key``, ``n_shingles`` and ``component_id``.

    As ``near_duplicates``, but rows with a null id take part, and the texts of an
    id that repeats are different members.  A component is named by the smallest
    ``row_key`` in it.
    """
    found = near_duplicates(docs.select(row_key().alias("doc_id"), "text", F.struct(*carry).alias("row")), carry="row")
    return found.select("row.*", F.col("doc_id").alias("row_key"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of one row of each group of near-duplicates in ``docs(doc_id, text, ...)``.

    The row with the smallest id stays, null ids last; of rows with equal id and
    text the one with the smallest other columns.  Rows without a word are in no group, and all stay.
    """
    rows = groups(docs, "doc_id").where("n_shingles > 0").groupBy("component_id", "doc_id", "row_key").agg(F.count("*").alias("copies"))
    rows = keep(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")))
    first = rows.groupBy("component_id").agg(F.min("place").alias("first"), F.sum("copies").alias("members")).where("members > 1")
    # what has to go, and what stays but repeats
    odd = rows.join(first, "component_id").select("row_key", (F.col("place") == F.col("first")).alias("stays"), "copies")
    odd = keep(odd.where("not stays or copies > 1").groupBy("row_key").agg(F.max("stays").alias("stays")))
    keyed = docs.select(*columns, row_key().alias("row_key"))
    out = keyed.join(odd, "row_key", "left_anti").select(columns)
    once = odd.where("stays").select("row_key")
    if once.isEmpty():
        return out
    least = keyed.join(once, "row_key").groupBy("row_key").agg(F.min(F.struct(*columns)).alias("row"))
    return out.union(least.select("row.*"))


def _crowded_links(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of ``crowd(rep, n, component, low)``: members of crowded buckets, each with its bucket's first.

    Buckets that share members form a cluster.  A cluster is dealt into blocks,
    and one task compares two blocks and returns confirmed links only.
    """
    cluster = components(crowd.select(F.col("rep").alias("u"), F.col("low").alias("v"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    placed = crowd.select("rep", "n", "component").distinct().join(cluster, "rep")
    blocks_of = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    sized = placed.groupBy("cluster").agg(blocks_of.alias("blocks"))
    dealt = (
        placed.join(sized, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("against", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cluster", "rep", "component", "block", F.least("block", "against").alias("i"), F.greatest("block", "against").alias("j"))
    )
    met = dealt.join(sets.select("rep", "shingles"), "rep").groupBy("cluster", "i", "j")
    return met.applyInArrow(_block_links(percent), "u long, v long")


def _sizes_allow(a: str, b: str, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
