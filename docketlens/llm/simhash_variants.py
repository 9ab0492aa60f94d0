"""SimHash near duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (21, 21 and 22 bits). Of two fingerprints with at most
four differing bits, one segment differs in one bit or none: four bits in three segments. Every segment
is indexed once for each of its bits with that bit deleted, so two segments that differ in at most one bit
share a variant. Equal variants are brought together by a shuffle on the variant, and each candidate pair
is verified on all 64 bits. 64 short keys per distinct fingerprint find every link; there is no cap.

Fingerprints that agree are collapsed first, so a group of exact copies is one row. Inside a run of equal
variants only a spanning set of verified links is kept, never all pairs. A run longer than ``block`` is cut
into blocks and its block pairs are verified in separate tasks.

Defined results:

* NULL and empty texts have fingerprint 0, and 0 links like any other fingerprint.
* Repeated rows have equal fingerprints and share a component; every input row is returned.
* A component's id is its smallest ``doc_id``; rows without an id count only if no member has one (NULL).
* Very long texts are hashed in slices of ``SLICE`` shingles, with counts added up.
* An empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketlens.llm.components import stars
from docketlens.llm.words import shuffle_partitions
from docketlens.session import cut_lineage

MAX_BITS = 4
# (first bit, width) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BLOCK = 1024
SLICE = 1 << 18
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _simhash(text: bytes, k: int, hasher) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-k] + 1))
        spans = list(zip(starts.tolist(), ends[k - 1:].tolist()))
    counts = np.zeros((8, 256), np.int64)
    lanes = np.arange(8) * 256
    for at in range(0, len(spans), SLICE):
        part = spans[at:at + SLICE]
        h = np.fromiter((hasher(joined[a:b], 42) for a, b in part), np.uint64, len(part))
        seen = h.view(np.uint8).reshape(-1, 8) + lanes
        counts += np.bincount(seen.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash over word shingles of each text, A-Z taken as a-z."""

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((_simhash(t.as_py() or b"", shingle, xxh64_intdigest) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(hash_batches, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def variants(fp: Column) -> Column:
    """array<int>: one key for each deleted bit, the bit's number above the rest of its segment."""
    keys = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        for q in range(width):
            rest = F.shiftleft(F.shiftrightunsigned(segment, q + 1), q).bitwiseOR(segment.bitwiseAND(F.lit((1 << q) - 1)))
            keys.append((rest + F.lit((first + q) << 21)).cast("int"))
    return F.array(*keys)


def _tree(fps: np.ndarray, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that connect what is connected among ``fps`` (and across to ``other``), each node once."""
    todo = np.unique(fps if other is None else np.concatenate([fps, other]))
    links = []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            near = np.bitwise_count(front[:256, None] ^ todo[None, :]) <= MAX_BITS
            hit = near.any(axis=0)
            parent = front[:256][near[:, hit].argmax(axis=0)]
            links += zip(parent.view(np.int64).tolist(), todo[hit].view(np.int64).tolist())
            front, todo = np.concatenate([front[256:], todo[hit]]), todo[~hit]
    return links


def _runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) rows -> links of short runs (key NULL) and the members of long ones (b NULL)."""

    def links(pairs) -> pa.RecordBatch:
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int32()), pa.array(a), pa.array(b)], names=["key", "a", "b"])

    def members(key: int, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), key, np.int32)), pa.array(fps.view(np.int64)),
                                           pa.nulls(len(fps), pa.int64())], names=["key", "a", "b"])

    rest_k, rest_f, long_run = np.zeros(0, np.int32), np.zeros(0, np.uint64), None
    for b in batches:
        keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        if long_run is not None:
            same = int(np.searchsorted(keys, long_run, "right"))
            if same:
                yield members(long_run, fps[:same])
            if same == len(keys):
                continue
            keys, fps, long_run = keys[same:], fps[same:], None
        keys, fps = np.concatenate([rest_k, keys]), np.concatenate([rest_f, fps])
        # The last run may go on in the next batch.
        done = int(np.searchsorted(keys, keys[-1]))
        yield from _whole_runs(keys[:done], fps[:done], links, members, block)
        rest_k, rest_f = keys[done:], fps[done:]
        if len(rest_k) > block:
            long_run = int(rest_k[0])
            yield members(long_run, rest_f)
            rest_k, rest_f = rest_k[:0], rest_f[:0]
    yield from _whole_runs(rest_k, rest_f, links, members, block)


def _whole_runs(keys: np.ndarray, fps: np.ndarray, links, members, block: int) -> Iterator[pa.RecordBatch]:
    if len(keys) < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    two = starts[sizes == 2]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= MAX_BITS]
    found = list(zip(fps[two].view(np.int64).tolist(), fps[two + 1].view(np.int64).tolist()))
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if n > block:
            yield members(int(keys[s]), fps[s:s + n])
        else:
            found += _tree(fps[s:s + n])
    if found:
        yield links(found)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links between distinct fingerprints that connect all that is connected.

    The input has one column fp without repeats.
    """
    n = shuffle_partitions(fps.sparkSession)
    # Each row becomes 64, so rows are dealt out before that, not by the size they have now.
    keyed = fps.repartition(n).select(F.explode(variants(F.col("fp"))).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key")
    out = cut_lineage(keyed.mapInArrow(partial(_runs, block=block), "key int, a long, b long"))
    hot = out.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).alias("n"))
    placed = hot.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp", "key"), "n"))
    # A row of block i meets every block j: pair (least, greatest).
    pairs = placed.select("key", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).select(
        "key", "fp", (F.col("block") <= F.col("j")).alias("left"), F.least("block", "j").alias("i"), F.greatest("block", "j").alias("j"))

    def verify(table: pa.Table) -> pa.Table:
        found = _tree(np.unique(table.column("fp").to_numpy()).view(np.uint64))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    far = pairs.groupBy("key", "i", "j").applyInArrow(verify, "a long, b long")
    return out.filter("key IS NULL").select("a", "b").union(far).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row."""
    fps = cut_lineage(fingerprints(docs, id_col, text, shingle))
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    roots = stars(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written before the join, whose sides are then plain exchanges: a large component's partition can be split.
    smallest = cut_lineage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return fps.join(rooted.select("fp", "root").join(smallest, "root").drop("root"), "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest (id, digest of the text); all columns of the input.

    Rows with equal ids but other texts are other documents. A row without an id stands behind all that have one. Of
    rows with the same id and text one stays.
    """
    no_id = F.col("doc_id").isNull()
    key = F.struct(no_id.alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"), F.col("text").alias("_text"))
    keep = near_duplicates(rows.select("_key", "_text"), "_key", "_text").filter("_key = component_id").select("_key").distinct()
    # Copies of one row are combined before the shuffle; a NULL text stands before an empty one, then the row's hash decides.
    first = F.min_by("_row", F.struct("_text", F.xxhash64("_row")))
    return rows.groupBy("_key").agg(first.alias("_row")).join(keep, "_key", "left_semi").select("_row.*")
