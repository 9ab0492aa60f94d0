"""Near-duplicate clusters over a whole table.

Rows with equal normalised texts are collapsed first. Each distinct text gets 480 minimum hashes of its character
shingles, in 60 bands of 8: two texts whose shingle sets have Jaccard j share no band with probability
(1 - j^8)^60. Texts that share a band and whose 448 sampled bits differ in at most 77 are candidates, and each
candidate link is checked on the exact shingle sets. Clusters are the connected components of the checked links.

Links are found in two steps. Each member of a band first meets the smallest member; then all pairs of a band that
are still in different components meet, bands of many members in pairs of blocks. So no candidate is left
out, and a group of near copies does not emit all its pairs.

Long strangers of one language come close to the threshold: each is a candidate with very many others. Candidates between
such nodes first meet on odd sketches, in pairs of blocks. A bit of an odd sketch is the parity of the shingles on it, so two
sketches differ in no more bits than the sets have different shingles: what this drops cannot be a link.

Defined results:

* Texts without a letter or digit are near nothing; each such row is a cluster of its own.
* Equality of texts is that of a 64-bit hash of the normalised text.
* ``cluster_id`` is the smallest ``doc_id``; the representative is the longest row, ties by the largest ``doc_id``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketlens import rules
from docketlens.operators.components import stars
from docketlens.session import checked_broadcast, cut_lineage

BANDS, BAND_ROWS = 60, 8
SKETCH_WORDS, SKETCH_BITS_APART = 7, 77
BLOCK, SMALL_BAND = 2048, 32
HOT_LINKS = 256
DENSE_LINKS = 32
ODD_BLOCK, ODD_BLOCKS, ODD_BITS = 8192, 8, 1 << 15
WANTED_ROWS = 1_000_000
_PART = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = (_SEEDS[::2] | np.uint64(1)).astype(np.uint32)[:, None]
_OFFSET = _SEEDS[1::2].astype(np.uint32)[:, None]


_KEPT = np.zeros(1 << 16, bool)
for _first, _last in ("09", "az", "AZ", "一鿿"):
    _KEPT[ord(_first):ord(_last) + 1] = True


def normal_codes(text: str | None) -> np.ndarray:
    """The characters that ``char_class_norm`` keeps; all of them fit 16 bits."""
    c = np.frombuffer((text or "").lower().encode("utf-16-le", "surrogatepass"), "<u2")
    return c[_KEPT[c]]


def shingle_set(codes: np.ndarray) -> np.ndarray:
    """The distinct shingles, each packed into 64 bits."""
    assert rules.SHINGLE_LENGTH == 4
    c = codes.astype(np.uint64)
    if len(c) < 4:
        c = np.concatenate([c, np.zeros(4 - len(c), np.uint64)])
    return np.unique(c[:-3] | (c[1:-2] << np.uint64(16)) | (c[2:-1] << np.uint64(32)) | (c[3:] << np.uint64(48)))


def packed(shingles: np.ndarray) -> bytes:
    """A shingle set as compressed byte planes of its differences: a fraction of a long text, and exact."""
    return zlib.compress(np.diff(shingles, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _signed(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, sketch words) of one shingle set."""
    x = _mixed(shingles).astype(np.uint32)
    low = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), _PART // 8):
        part = x[lo:lo + _PART // 8]
        step = min(len(low), _PART // len(part))
        held = np.empty((step, len(part)), np.uint32)
        for at in range(0, len(low), step):
            h = np.multiply(part, _FACTOR[at:at + step], out=held[:len(low) - at])
            h += _OFFSET[at:at + step]
            np.minimum(low[at:at + step], h.min(axis=1), out=low[at:at + step])
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(BAND_ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + low[r::BAND_ROWS][:BANDS])
    bits = ((low[:64 * SKETCH_WORDS] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits, bitorder="little").view(np.int64)


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, raw, text) -> the row with its node (NULL without a kept character), band keys and sketch."""
    for b in batches:
        nodes, keys, sketches = [], [], []
        for t in b.column("text").to_pylist():
            codes = normal_codes(t)
            nodes.append(int.from_bytes(blake2b(codes.tobytes(), digest_size=8).digest(), "little", signed=True) if len(codes) else None)
            k, s = _signed(shingle_set(codes)) if len(codes) else ([], np.zeros(SKETCH_WORDS, np.int64))
            keys.append(k)
            sketches.append(s)
        columns = np.array(sketches, np.int64).reshape(-1, SKETCH_WORDS)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("raw"), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                                          *[pa.array(np.ascontiguousarray(columns[:, i])) for i in range(SKETCH_WORDS)]],
                                         names=["row", "raw", "node", "keys", *_SKETCH])


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles on each bit; four bits a shingle at least, up to ``ODD_BITS``. Its halves, combined by XOR, are the sketch of half the bits."""
    bits = min(max(64, 1 << (4 * len(shingles) - 1).bit_length()), ODD_BITS)
    at = (_mixed(shingles) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


class _OddBlock:
    """The odd sketches of some nodes."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, sketches: list[bytes]):
        order = np.argsort(nodes)
        self.nodes, self.sizes = nodes[order], sizes[order]
        self.words = np.array([len(sketches[i]) // 8 for i in order])
        self.row, self.held = np.zeros(len(order), np.int64), {}
        for w in np.unique(self.words).tolist():
            of = np.flatnonzero(self.words == w)
            self.row[of] = np.arange(len(of))
            self.held[w] = np.frombuffer(b"".join(sketches[order[i]] for i in of), np.uint64).reshape(-1, w)

    def _folded(self, of: np.ndarray, words: int, to: int) -> np.ndarray:
        return np.bitwise_xor.reduce(self.held[words][self.row[of]].reshape(len(of), -1, to), axis=1)

    def may_link(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """False only where the shingle sets of a and b cannot overlap enough."""
        x, y = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        total, most = self.sizes[x] + self.sizes[y], np.minimum(self.sizes[x], self.sizes[y])
        kept = most >= (total - most) * threshold
        for wx, wy in {*zip(self.words[x[kept]].tolist(), self.words[y[kept]].tolist())}:
            of = np.flatnonzero(kept & (self.words[x] == wx) & (self.words[y] == wy))
            for i in range(0, len(of), 1024):
                at, w = of[i:i + 1024], min(wx, wy)
                apart = np.bitwise_count(self._folded(x[at], wx, w) ^ self._folded(y[at], wy, w)).sum(axis=1, dtype=np.int64)
                most[at] = np.minimum(most[at], (total[at] - apart) // 2)
        return most >= (total - most) * threshold


def _runs(columns: list[np.ndarray]) -> list[int]:
    """Where runs of equal values in all columns begin, and the end."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [0, *np.flatnonzero(new).tolist(), len(new)]


def _thinned(pairs: DataFrame, have: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that may be links by the odd sketches of ``have`` (node, n, odd), which has both nodes of each pair."""
    def block(node: str):
        return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sketches = have.withColumn("at", block("node")).withColumn("other", every).select(
        F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "n", "odd")
    dealt = pairs.select(F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b",
                         F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("odd"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The sketches of a pair of blocks stand before its pairs.
        at, parts, held = None, [], None
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            paired = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            cuts = _runs([i, j, paired])
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if (i[lo], j[lo]) != at:
                    at, parts, held = (i[lo], j[lo]), [], None
                run = batch.slice(lo, hi - lo)
                if not paired[lo]:
                    parts.append((run.column("a").to_numpy(), run.column("n").to_numpy(), run.column("odd").to_pylist()))
                    continue
                if held is None:
                    held = _OddBlock(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [o for p in parts for o in p[2]])
                    parts = []
                near = held.may_link(run.column("a").to_numpy(), run.column("b").to_numpy(), threshold)
                yield run.select(["a", "b"]).filter(pa.array(near))

    return (sketches.union(dealt).repartition("i", "j").sortWithinPartitions("i", "j", F.col("b").isNotNull())
            .mapInArrow(meet, "a long, b long"))


def _named(sketches: DataFrame, node: str) -> DataFrame:
    return sketches.select(F.col("node").alias(node), *[F.col(c).alias(f"{node}_{c}") for c in _SKETCH])


def _close(a: str, b: str):
    apart = F.lit(0)
    for c in _SKETCH:
        apart = apart + F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}")))
    return apart <= SKETCH_BITS_APART


def _met(held: DataFrame) -> DataFrame:
    """The close pairs (a, b), a < b, of each band whose roots differ; a pair may come more than once. A band's blocks meet in pairs."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["key", "i", "j", "block", "node", "root", *_SKETCH]
    dealt = held.withColumn("other", every).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(columns)

    def close(group: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        node, root, block, sketch = group["node"], group["root"], group["block"], group["sketch"]
        i, j = group["i"][0], group["j"][0]
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        step = max(1, (1 << 18) // max(1, len(y)))
        for lo in range(0, len(x), step):
            part = x[lo:lo + step]
            apart = np.zeros((len(part), len(y)), np.uint16)
            for w in range(SKETCH_WORDS):
                apart += np.bitwise_count(sketch[w][part][:, None] ^ sketch[w][y][None, :])
            near = (apart <= SKETCH_BITS_APART) & (root[part][:, None] != root[y][None, :])
            if i == j:
                near &= node[part][:, None] < node[y][None, :]
            p, q = np.nonzero(near)
            if len(p):
                p, q = node[part[p]], node[y[q]]
                yield np.stack([np.minimum(p, q), np.maximum(p, q)])

    def alike(now: dict[str, np.ndarray], starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
        # Bands of one size at once.
        p, q = np.triu_indices(size, 1)
        step = max(1, (1 << 18) // len(p))
        for lo in range(0, len(starts), step):
            x, y = (starts[lo:lo + step, None] + p).ravel(), (starts[lo:lo + step, None] + q).ravel()
            apart_roots = now["root"][x] != now["root"][y]
            x, y = x[apart_roots], y[apart_roots]
            near = np.bitwise_count(now["sketch"][:, x] ^ now["sketch"][:, y]).sum(axis=0, dtype=np.uint16) <= SKETCH_BITS_APART
            p_node, q_node = now["node"][x[near]], now["node"][y[near]]
            yield np.stack([np.minimum(p_node, q_node), np.maximum(p_node, q_node)])

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rest, found = None, []
        for batch in chain(batches, [None]):
            if batch is None:
                if rest is None:
                    break
                now, last = rest, True
            else:
                now = {c: batch.column(c).to_numpy() for c in columns[:6]} | {"sketch": np.stack([batch.column(c).to_numpy().view(np.uint64) for c in _SKETCH])}
                now, last = (now if rest is None else {c: np.concatenate([rest[c], now[c]], axis=-1) for c in now}), False
            cuts = np.array(_runs([now["key"], now["i"], now["j"]]))
            ends = cuts if last else cuts[:-1]
            size, single = np.diff(ends), (now["i"] == now["j"])[ends[:-1]]
            small = (size <= SMALL_BAND) & single
            for g in np.unique(size[small & (size > 1)]).tolist():
                found += alike(now, ends[:-1][small & (size == g)], g)
            for at in np.flatnonzero(~small).tolist():
                found += close({c: v[..., ends[at]:ends[at + 1]] for c, v in now.items()})
                if sum(x.shape[1] for x in found) > 1 << 16:
                    yield out(found)
                    found = []
            rest = {c: v[..., ends[-1]:] for c, v in now.items()}
        yield out(found)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(pairs_of, "a long, b long")


def _checked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets overlap enough; ``texts`` is (raw, text), copies allowed."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingle_set(normal_codes(t)) for t in b.column("text").to_pylist()]
            odd = [odd_sketch(x) if d else None for x, d in zip(held, b.column("dense").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([packed(x) for x in held], pa.binary()), pa.array([len(x) for x in held], pa.int64()),
                                              pa.array(odd, pa.binary())], names=["node", "shingles", "n", "odd"])

    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    wanted = cut_lineage(nodes.select("node", "raw").join(used, "node"))
    # A sketch goes once to each block, so a node with fewer links than that is checked link by link.
    blocks = max(ODD_BLOCKS, -(-wanted.count() // ODD_BLOCK))
    wanted = wanted.withColumn("dense", F.col("links") >= max(DENSE_LINKS, 2 * blocks))
    have = cut_lineage(texts.join(checked_broadcast(wanted.select("raw"), WANTED_ROWS), "raw", "left_semi").dropDuplicates(["raw"]).join(wanted, "raw")
                       .select("node", "text", "dense").mapInArrow(sets, "node long, shingles binary, n long, odd binary"))
    dense = wanted.filter("dense").select("node")
    for node in ("a", "b"):
        pairs = pairs.join(checked_broadcast(dense.select(F.col("node").alias(node), F.lit(True).alias(f"{node}_dense"))), node, "left")
    both_dense = F.coalesce(F.col("a_dense") & F.col("b_dense"), F.lit(False))
    pairs = cut_lineage(_thinned(pairs.filter(both_dense), have.filter("odd IS NOT NULL").select("node", "n", "odd"), blocks, threshold)
                        .union(pairs.filter(~both_dense).select("a", "b")))
    have = have.select("node", "shingles")

    def with_set(df: DataFrame, node: str, other: str) -> DataFrame:
        # A node with very many links stands in several copies, each for a part of them.
        copies = df.groupBy(F.col(node).alias("node")).agg(F.ceil(F.count("*") / F.lit(HOT_LINKS)).cast("int").alias("n"))
        spread = have.join(copies, "node").select(F.col("node").alias(node), F.col("shingles").alias(f"set_{node}"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
        dealt = df.join(copies.withColumnRenamed("node", node).filter("n > 1"), node, "left").withColumn(
            "copy", F.coalesce(F.pmod(F.xxhash64(other), F.col("n")), F.lit(0)).cast("int")).drop("n")
        return dealt.join(spread, [node, "copy"]).drop("copy")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                x, y = unpacked(x), unpacked(y)
                n = len(np.intersect1d(x, y, assume_unique=True))
                near.append(n >= (len(x) + len(y) - n) * threshold)
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = with_set(with_set(pairs, "a", "b"), "b", "a").select("a", "b", "set_a", "set_b")
    return cut_lineage(both.mapInArrow(check, "a long, b long"))


def clusters(docs: DataFrame, threshold: float = rules.DUPLICATE_THRESHOLD) -> DataFrame:
    """(cluster_id, copies, representative) of every near-duplicate cluster of (doc_id, n_chars, text)."""
    row = F.struct("n_chars", "doc_id").alias("row")
    texts = docs.select(F.xxhash64("text").alias("raw"), "text")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    found = docs.select(row, F.xxhash64("text").alias("raw"), "text").mapInArrow(
        _sketches, f"row {kind}, raw long, node long, keys array<long>, {', '.join(c + ' long' for c in _SKETCH)}")
    signed = cut_lineage(found)
    empty = signed.filter("node IS NULL").select(F.col("row.doc_id").alias("cluster_id"), F.lit(1).cast("long").alias("copies"), F.col("row.doc_id").alias("representative"))
    signed = signed.filter("node IS NOT NULL")
    nodes = cut_lineage(signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("row.doc_id").alias("first_id"), F.max("row").alias("best"),
                                                   F.min(F.struct("raw", "keys", *_SKETCH)).alias("s")).select("node", "copies", "first_id", "best", "s.*"))
    sketches = nodes.select("node", *_SKETCH)

    # Keys go without their sketches until the bands of one member are out.
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1").drop("n")
    bands = cut_lineage(keyed.join(shared, "key"))

    # First each member against the smallest one of its band.
    to_lead = bands.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    first = cut_lineage(to_lead.join(_named(sketches, "a"), "a").join(_named(sketches, "b"), "b").filter(_close("a", "b")).select("a", "b"))
    links = _checked(first, nodes, texts, threshold)
    roots = stars(links)

    # Then all pairs of a band that are in different components.
    rooted = bands.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most AND n > 2")
    open_bands = cut_lineage(rooted.join(mixed.select("key", F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks")), "key")
                             .withColumn("block", F.pmod(F.xxhash64("node"), "blocks")))
    second = _met(open_bands.join(sketches, "node")).distinct().join(first, ["a", "b"], "left_anti")
    roots = stars(links.union(_checked(cut_lineage(second), nodes, texts, threshold)))

    whole = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min("first_id").alias("cluster_id"), F.sum("copies").alias("copies"), F.max("best").alias("best"))
    return whole.select("cluster_id", "copies", F.col("best.doc_id").alias("representative")).unionByName(empty)
