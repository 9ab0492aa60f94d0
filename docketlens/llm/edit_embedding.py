"""Document fingerprints by a randomised edit embedding.

All texts are read by one shared random walk: at output position j the walk writes the current character and
moves on to the next one if a random bit of (j, character) is set. Two texts with few edits between them
write the same characters at most positions again soon after each edit, so edit distance becomes Hamming
distance. The fingerprint samples the output: 64 positions of each octave (the first 64 positions are the first
block), one random bit of the character at each. Its length thus grows with the logarithm of the text's, and
fingerprints of texts of any length can be compared.

The likeness of two fingerprints is the share of the longer output at which they agree: in each block the
part that both outputs cover counts by twice the agreeing samples less one, at least 0.

Bands for candidate search are bits sampled from the four largest blocks that a text fills.

Defined results:

* NULL and empty texts have the fingerprint ``0:``; two of them have likeness 1, one and any other text 0.
* Equal texts have equal fingerprints, whatever row they come from. Every row is returned.
* Very long texts are walked whole, one numpy step per character for all texts of a block together.
* ``next_document`` order is descending id, ties by text, NULL ids last; after the last comes the first.
* An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketlens.llm.tree_bpe import batches_by_bytes
from docketlens.llm.words import shuffle_partitions
from docketlens.session import cut_lineage

PERIOD, CLASSES, SAMPLES, OCTAVES = 8192, 256, 64, 40
CELLS = 2 << 20
STEP_BYTES = 4 << 20
BANDS, BAND_BITS = 8, 32


def _random(n: int, seed: int) -> np.ndarray:
    """n random 64-bit numbers: a counter through two multiply-and-shift rounds."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Walk:
    """The shared tables of one seed: how long each character stays, where to sample, and what bit to write."""

    def __init__(self, seed: int = 7):
        bits = (_random(PERIOD * CLASSES, seed) & np.uint64(1)).astype(bool).reshape(PERIOD, CLASSES)
        stay = np.full((PERIOD, CLASSES), 64, np.uint8)
        near = np.zeros(CLASSES, np.int64) + 64
        for j in range(2 * PERIOD - 1, -1, -1):
            near = np.where(bits[j % PERIOD], 1, np.minimum(near + 1, 64))
            if j < PERIOD:
                stay[j] = near
        self.stay = stay.ravel().astype(np.int64)
        blocks = [np.arange(SAMPLES)]
        for k in range(6, 6 + OCTAVES - 1):
            blocks.append(np.sort((1 << k) + (_random(SAMPLES, seed + k) % np.uint64(1 << k)).astype(np.int64)))
        self.places = np.concatenate(blocks)
        self.bits = (_random(len(self.places) * CLASSES, seed + 99) >> np.uint64(17) & np.uint64(1)).astype(np.uint8)

    def embed(self, texts: list[str]) -> list[str]:
        codes = [((np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(codes[i]))
        out, at = [""] * len(texts), 0
        while at < len(order):
            longest = len(codes[order[at]])
            some = order[at:at + max(1, CELLS // max(longest, 1))]
            at += len(some)
            for i, path in zip(some, self._paths([codes[i] for i in some])):
                out[i] = self._sample(codes[i], path)
        return out

    def _paths(self, codes: list[np.ndarray]) -> np.ndarray:
        """Output position at which each character begins, and the end; codes come longest first."""
        lengths = np.array([len(c) for c in codes])
        steps = int(lengths[0])
        chars = np.zeros((len(codes), steps), np.uint8)
        for row, c in zip(chars, codes):
            row[:len(c)] = c
        chars = np.ascontiguousarray(chars.T)
        active = np.searchsorted(-lengths, -np.arange(steps), "left")
        now = np.zeros(len(codes), np.int64)
        path = np.zeros((steps + 1, len(codes)), np.int32 if steps < 1 << 24 else np.int64)
        for i in range(steps):
            n = active[i]
            head = now[:n]
            head += self.stay[(head & (PERIOD - 1)) * CLASSES + chars[i, :n]]
            path[i + 1, :n] = head
        return np.ascontiguousarray(path.T)

    def _sample(self, codes: np.ndarray, path: np.ndarray) -> str:
        end = int(path[len(codes)])
        if not end:
            return "0:"
        blocks = 1 + max(0, (end - 1).bit_length() - 6)
        places = self.places[:blocks * SAMPLES]
        places = places[:np.searchsorted(places, end)]
        at = np.searchsorted(path[:len(codes) + 1], places, "right") - 1
        bits = np.zeros(blocks * SAMPLES, np.uint8)
        bits[:len(places)] = self.bits[np.arange(len(places)) * CLASSES + codes[at]]
        return f"{end:x}:{np.packbits(bits).tobytes().hex()}"

    def likeness(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        (la, xa), (lb, xb) = ((int(n, 16), np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8))) for n, x in (a.split(":"), b.split(":")))
        both = min(la, lb)
        if not both:
            return 0.0
        blocks = min(len(xa), len(xb)) // SAMPLES
        same = (xa[:blocks * SAMPLES] == xb[:blocks * SAMPLES]).reshape(blocks, SAMPLES)
        inside = (self.places[:blocks * SAMPLES] < both).reshape(blocks, SAMPLES)
        edges = np.concatenate(([0], 1 << np.arange(6, 6 + blocks)))
        covered = np.clip(both - edges[:-1], 0, np.diff(edges))
        agree = (same & inside).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
        return float((covered * np.maximum(2 * agree - 1, 0)).sum() / max(la, lb))


_walks: dict[int, Walk] = {}


def walk(seed: int = 7) -> Walk:
    if seed not in _walks:
        _walks[seed] = Walk(seed)
    return _walks[seed]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """(id, fingerprint) of every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in batches_by_bytes(whole, 1, STEP_BYTES)):
            found = walk(seed).embed([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def similar(prints: DataFrame, least: float = 0.8, seed: int = 7) -> DataFrame:
    """(a, b, likeness): verified links between distinct fingerprints that share a band.

    A band joins the number of blocks with ``BAND_BITS`` bits sampled from the four largest blocks. The members
    of a band are put in order and each is verified against the band's smallest member and the one before
    it, so a band with very many members yields two links per member and never all pairs.
    """
    hexes = F.substring_index("fingerprint", ":", -1)
    # Hex digits of the four blocks before the last, which is seldom full; one block is 16 digits.
    base = F.length(hexes) - 80
    take = _random(BANDS * (BAND_BITS // 4), seed + 3) % np.uint64(64)
    keys = [F.concat(F.lit(f"{i}:"), F.length(hexes).cast("string"), F.lit(":"),
                     *[F.substring(hexes, base + int(p) + 1, F.lit(1)) for p in take[i::BANDS]]) for i in range(BANDS)]
    distinct = prints.select("fingerprint").distinct().filter(F.length(hexes) >= 80)
    banded = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("band"))
    lead = banded.groupBy("band").agg(F.min("fingerprint").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    before = Window.partitionBy("band").orderBy("fingerprint")
    pairs = banded.join(lead, "band").withColumn("prior", F.lag("fingerprint").over(before)).filter("prior IS NOT NULL")
    pairs = pairs.select(F.col("fingerprint").alias("a"), F.explode(F.array("first", "prior")).alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([walk(seed).likeness(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), values], names=["a", "b", "likeness"])

    return pairs.mapInArrow(verify, "a string, b string, likeness double").filter(F.col("likeness") >= least)


_ROW = ("kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, text string")
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_FIRST, _LAST, _DONE = 0, 1, 2


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the following text, or all it has."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _compared(rows: list[tuple], following: list[str], seed: int) -> list[tuple]:
    """rows: (doc_id, text); one _DONE row for each, against the text that follows it."""
    w, n = walk(seed), len(rows)
    texts = [t for _, t in rows]
    changed = [edited(t, f) for t, f in zip(texts, following)]
    # Neighbours mostly follow each other, so most following texts are embedded already.
    unique = list(dict.fromkeys(texts + changed + following))
    prints = dict(zip(unique, w.embed(unique)))
    out = []
    for i in range(n):
        own, new, after = prints[texts[i]], prints[changed[i]], prints[following[i]]
        out.append((_DONE, 0, rows[i][0], len(texts[i]), hashlib.sha256(changed[i].encode()).hexdigest(), own, new,
                    w.likeness(own, new), w.likeness(own, after), None))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def neighbours(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness to it and to the next document.

    Texts move once, to ranges of ids; within a range each document meets the next one. The last document of
    each range meets the first of the next range in a second, small step: two rows per range.
    """
    n = shuffle_partitions(docs.sparkSession)
    order = F.desc_nulls_last("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n, order).sortWithinPartitions(order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, waiting = TaskContext.get().partitionId(), None
        for b in (p for whole in batches for p in batches_by_bytes(whole, 1, STEP_BYTES)):
            have = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if waiting is None:
                yield _batch([(_FIRST, part, have[0][0], None, None, None, None, None, None, have[0][1])])
            else:
                have = [waiting] + have
            waiting = have[-1]
            if len(have) > 1:
                yield _batch(_compared(have[:-1], [t for _, t in have[1:]], seed))
        if waiting is not None:
            yield _batch([(_LAST, part, waiting[0], None, None, None, None, None, None, waiting[1])])

    found = cut_lineage(ranged.mapInArrow(run, _ROW))
    firsts, lasts = found.filter(F.col("kind") == _FIRST), found.filter(F.col("kind") == _LAST)
    # One number per range that has rows.
    parts = sorted(r["part"] for r in firsts.select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    ends = (lasts.select("part", "doc_id", "text").join(F.broadcast(after), "part")
            .join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select("doc_id", "text", "following"))

    def run_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have = b.to_pylist()
            for r in have:
                yield _batch(_compared([(r["doc_id"], r["text"])], [r["following"]], seed))

    done = found.filter(F.col("kind") == _DONE).union(ends.mapInArrow(run_ends, _ROW))
    return done.drop("kind", "part", "text")
