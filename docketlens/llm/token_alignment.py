"""Alignment of two tokenizers over a corpus, scored by inverted pair bitmaps.

A text is encoded by a byte-level vocabulary (A, on space + text) and by a sentencepiece model (B, which adds the space). Byte
offsets where tokens of both end cut the text into groups; the two tokens that end there are a link. The count of
a pair of ids is the number of its links in the corpus.

Counts come from an inverted index. A task numbers its documents in blocks (up to 32,768 documents or ``BLOCK_LINKS`` links). For
each pair of a block there is a compressed bitmap of the documents that link it: the sorted 16-bit document numbers, or a plain
bitmap where that is smaller. Lots of documents are OR-merged into the bitmaps of their block. Multiplicity planes are bitmaps
too: plane k holds the documents in which bit k of (links - 1) is set. So the popcount of the presence bitmaps is a pair's
document count, and with plane k weighing 2 ** k the popcounts add up to its link count. The index is written once; counts
are one aggregate over it. Scores then go back along the postings: index rows meet their pair's score and are
dealt to their block, where each posting adds its score to its document. A very common pair is one row per block.

Work is done once per distinct unit (white space and what follows it): neither vocabulary has a token with white space behind
another character, except for the carriage return in B. Texts with that are aligned whole.

Defined results:

* NULL and empty texts, and texts whose joined token bytes differ from space + text, have no tokens: zeros and empty groups.
* Strings of special tokens are plain text. Very long texts are handled by unit like others. Repeated rows count each.
* ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and ``groups`` replace columns of these names; other
  kept columns pass unread. An empty table gives an empty result.
* The index has a block number per task and count, so what a lost task had written is replaced as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from docketlens.llm.tree_bpe import STEP_BYTES, batches_by_bytes
from docketlens.llm.units import CUTS, NOT_LATIN, Units, byte_of_char, bytes_of_token
from docketlens.llm.words import free_name, shuffle_partitions
from docketlens.session import checkpoint_dir

BLOCK_DOCS = 1 << 15
BLOCK_LINKS = 4 << 20
MAX_CACHED = 300_000
MAX_KEPT_CHARS = 256
SPACE_MARK = "▁"
MADE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
TASK_BLOCKS = 1 << 32

_loaded: dict[tuple[str, str], "Aligner"] = {}

# (A tokens, B tokens, groups, groups as text, codes of the linked pairs as 32-bit integers)
Record = tuple[int, int, int, str, bytes]


class Aligner:
    """Both vocabularies with the records of units; one per worker process."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.units = Units(path_a, "led")
        self.plain = Units(path_a, "led").tokenizer
        self.plain.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_b = self.pieces.vocab_size()
        table = byte_of_char()
        self.bytes_a = {i: bytes_of_token(t, table) if set(t) <= table.keys() else t.encode() for t, i in self.plain.get_vocab().items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(self.n_b))]
        self.lone = self.pieces.piece_to_id(SPACE_MARK)
        self.kept: dict[str, Record | None] = {}

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in _loaded:
            _loaded[path_a, path_b] = cls(path_a, path_b)
        return _loaded[path_a, path_b]

    def ids_a(self, led: str) -> list[int]:
        """A's ids of a text that has its leading space; strings of special tokens are plain text."""
        if self.units.whole is not None and not NOT_LATIN.search(led):
            try:
                return self.units.whole.coder.encode_ordinary(led)
            except ValueError:
                pass
        return self.plain.encode(led, add_special_tokens=False).ids

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """B's ids of units; B puts a space before each, which is the unit's own or is taken away again."""
        got = self.pieces.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.lone] if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, got)]

    def record(self, text: bytes, a: list[int], b: list[int]) -> Record | None:
        """None where the bytes of the tokens are not those of the text."""
        part_a, part_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(part_a) != text or b"".join(part_b) != text:
            return None
        groups, pairs, i, j, at_a, at_b, first_a, first_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a, i = at_a + len(part_a[i]), i + 1
            else:
                at_b, j = at_b + len(part_b[j]), j + 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                pairs.append(a[i - 1] * self.n_b + b[j - 1])
                first_a, first_b = i, j
        return len(a), len(b), len(groups), ";".join(groups), np.array(pairs, "<i4").tobytes()

    def of_texts(self, texts: list[str]) -> list[list[Record] | None]:
        """The records of each text's units, in order; None where the text has no tokens."""
        led = [" " + t if t else None for t in texts]
        units = [CUTS["led"].findall(t) if t is not None and "\r" not in t else () for t in led]
        new = set().union(*units).difference(self.kept)
        if len(self.kept) + len(new) > MAX_CACHED:
            for u in list(islice(self.kept, len(self.kept) // 2 + 1)):
                del self.kept[u]
            new = set().union(*units).difference(self.kept)
        new = list(new)
        for u, b in zip(new, self.ids_b(new)):
            self.kept[u] = self.record(u.encode(), self.ids_a(u), b)
        out = []
        for t, us in zip(led, units):
            if t is None:
                out.append(None)
            elif us:
                records = list(map(self.kept.__getitem__, us))
                out.append(None if None in records else records)
            else:
                whole = self.record(t.encode(), self.ids_a(t), self.pieces.encode(t[1:]))
                out.append(None if whole is None else [whole])
        for u in new:
            if len(u) > MAX_KEPT_CHARS:
                del self.kept[u]
        return out


class Block:
    """Postings of the pairs of up to ``BLOCK_DOCS`` documents."""

    def __init__(self, most: int = BLOCK_LINKS):
        self.most, self.docs, self.links, self.codes, self.numbers = most, 0, 0, [], []

    def add(self, codes: np.ndarray) -> int:
        """Takes the linked pairs of the next document and returns its number."""
        number, self.docs, self.links = self.docs, self.docs + 1, self.links + len(codes)
        self.codes.append(codes)
        self.numbers.append(len(codes))
        return number

    def full(self) -> bool:
        return self.docs == BLOCK_DOCS or self.links >= self.most

    def planes(self) -> Iterator[tuple[int, np.ndarray, list[bytes] | pa.Array, bool]]:
        """(plane, pairs, bitmaps, plain) with plane -1 for presence; bitmaps are number lists or, if plain, bit by bit."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        key = codes.astype(np.int64) * BLOCK_DOCS + np.repeat(np.arange(self.docs), self.numbers)
        key, times = np.unique(key, return_counts=True)
        pairs, numbers, more = (key // BLOCK_DOCS).astype(np.int32), (key % BLOCK_DOCS).astype("<u2"), times - 1
        yield from self._plane(-1, pairs, numbers)
        k = 0
        while (more >> k).any():
            held = (more >> k & 1).astype(bool)
            yield from self._plane(k, pairs[held], numbers[held])
            k += 1

    def _plane(self, plane: int, pairs: np.ndarray, numbers: np.ndarray) -> Iterator[tuple]:
        starts = np.flatnonzero(np.diff(pairs, prepend=-1))
        ends = np.append(starts[1:], len(pairs))
        size = (self.docs + 7) // 8
        plain = (ends - starts) * 2 > size
        bitmaps = []
        for s, e in zip(starts[plain], ends[plain]):
            bits = np.zeros(size * 8, np.uint8)
            bits[numbers[s:e]] = 1
            bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
        if bitmaps:
            yield plane, pairs[starts[plain]], bitmaps, True
        listed = np.repeat(~plain, ends - starts)
        sizes = (ends - starts)[~plain]
        if len(sizes):
            offsets = np.append(0, np.cumsum(sizes * 2)).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(numbers[listed].tobytes())])
            yield plane, pairs[starts[~plain]], column, False


def build_index(docs: DataFrame, path_a: str, path_b: str, text: str, keep: list[str], groups: bool, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Document rows (row, block, number and ``MADE``) and index rows (pair, plane, plain, block, bitmap) of one pass."""
    there = free_name(keep, "_there")
    rows = docs.select(F.struct(F.lit(True).alias(there), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    made = StructType.fromDDL(MADE)
    out = StructType([StructField("row", rows.schema["row"].dataType, True), *StructType.fromDDL("block long, number int"), *made, *StructType.fromDDL("pair int, plane int, plain boolean, bitmap binary")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block, held, kind = Aligner.of(path_a, path_b), Block(block_links), [], None
        at = TaskContext.get().partitionId() * TASK_BLOCKS

        def batch(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            types = {"row": kind, "block": pa.int64(), "number": pa.int32(), "groups_sha256": pa.string(), "groups": pa.string(), "pair": pa.int32(),
                     "plane": pa.int32(), "plain": pa.bool_(), "bitmap": pa.binary()}
            arrays = []
            for name in out.names:
                t, c = types.get(name, pa.int64()), columns.get(name)
                arrays.append(pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t))
            return pa.RecordBatch.from_arrays(arrays, names=out.names)

        def doc_rows() -> pa.RecordBatch:
            columns = dict(zip(("row", "number", *made.names), zip(*held)))
            held.clear()
            return batch(block=[at] * len(columns["row"]), **columns)

        def index_rows() -> Iterator[pa.RecordBatch]:
            for plane, pairs, bitmaps, plain in block.planes():
                yield batch(pair=pairs, plane=np.full(len(pairs), plane, np.int32), plain=np.full(len(pairs), plain), block=np.full(len(pairs), at, np.int64), bitmap=bitmaps)

        for b in (p for whole in batches for p in batches_by_bytes(whole, 1, STEP_BYTES)):
            kind = b.schema.field(0).type
            for row, records in zip(b.column(0).to_pylist(), aligner.of_texts(b.column(1).to_pylist())):
                if records is None:
                    held.append((row, block.add(np.zeros(0, np.int32)), 0, 0, 0, 0, "", "" if groups else None))
                else:
                    codes, said = np.frombuffer(b"".join([r[4] for r in records]), "<i4"), ";".join([r[3] for r in records])
                    held.append((row, block.add(codes), sum([r[0] for r in records]), sum([r[1] for r in records]), sum([r[2] for r in records]), len(codes),
                                 hashlib.sha256(said.encode()).hexdigest(), said if groups else None))
                if block.full():
                    yield doc_rows()
                    yield from index_rows()
                    block, at = Block(block_links), at + 1
            if held:
                yield doc_rows()
        yield from index_rows()

    return rows.mapInArrow(write, out)


def popcount() -> Column:
    return F.when(F.col("plain"), F.bitmap_count("bitmap")).otherwise(F.octet_length("bitmap") / 2).cast("long")


def weight() -> Column:
    return F.when(F.col("plane") < 0, F.lit(1)).otherwise(F.pow(F.lit(2), F.col("plane"))).cast("long")


def pair_counts(index: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best): best where no other pair of the B id has more links."""
    counts = index.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, popcount()).otherwise(0)).alias("n_docs"), F.sum(popcount() * weight()).alias("n_links"))
    counts = counts.withColumns({"a": F.floor(F.col("pair") / n_b).cast("int"), "b": (F.col("pair") % n_b).cast("int")})
    top = counts.groupBy("b").agg(F.max("n_links").alias("top")).withColumnRenamed("b", "top_b")
    return counts.join(top, F.col("b") == F.col("top_b")).select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, number, n_best, count_sum) of the documents with links: every posting returns its pair's score."""
    found = index.join(counts.select("pair", "n_links", "best"), "pair").select(
        "block", "plain", "bitmap", (F.col("n_links") * weight()).alias("count"), F.when(F.col("best"), weight()).otherwise(0).alias("best"))
    dealt = found.repartition(shuffle_partitions(index.sparkSession), "block").sortWithinPartitions("block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total = None, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)

        def done() -> pa.RecordBatch:
            numbers = np.flatnonzero(total)
            got = pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), block, np.int64)), pa.array(numbers.astype(np.int32)),
                                              pa.array(best[numbers]), pa.array(total[numbers])], names=["block", "number", "n_best", "count_sum"])
            best[:], total[:] = 0, 0
            return got

        for b in batches:
            blocks = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(blocks)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
                if block is not None and blocks[s] != block:
                    yield done()
                block = int(blocks[s])
                part = b.slice(s, e - s)
                plain = part.column(1).to_numpy(zero_copy_only=False)
                count, at_best = part.column(3).to_numpy(), part.column(4).to_numpy()
                listed = part.column(2).filter(pa.array(~plain))
                sizes = pc.binary_length(listed).to_numpy() // 2
                numbers = np.frombuffer(b"".join(listed.to_pylist()), "<u2")
                np.add.at(total, numbers, np.repeat(count[~plain], sizes))
                np.add.at(best, numbers, np.repeat(at_best[~plain], sizes))
                for i in np.flatnonzero(plain):
                    held = np.flatnonzero(np.unpackbits(np.frombuffer(part.column(2)[int(i)].as_buffer(), np.uint8), bitorder="little"))
                    total[held] += count[i]
                    best[held] += at_best[i]
        if block is not None:
            yield done()

    return dealt.mapInArrow(read, "block long, number int, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, groups: bool = False,
          block_links: int = BLOCK_LINKS) -> DataFrame:
    """The columns ``keep`` (all by default) with counts, scores and digest of each document, and its ``groups`` if asked.

    Groups are written ``a1,a2|b1;a3|b2,b3``.
    """
    import sentencepiece

    made = [*StructType.fromDDL(MADE).names, "n_best", "count_sum"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    folder = f"{checkpoint_dir(docs.sparkSession)}/alignment-{uuid4().hex}"
    build_index(docs, path_a, path_b, text, names, groups, block_links).write.parquet(folder)
    both = docs.sparkSession.read.parquet(folder)
    index = both.filter("pair IS NOT NULL").select("block", "pair", "plane", "plain", "bitmap")
    there = free_name(names, "_there")
    rows = both.filter("number IS NOT NULL").select("row", "block", "number", *StructType.fromDDL(MADE).names)
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    found = scores(index, pair_counts(index, n_b))
    out = rows.join(found, ["block", "number"], "left").withColumns({"n_best": F.coalesce("n_best", F.lit(0)), "count_sum": F.coalesce("count_sum", F.lit(0))})
    return out.select("row.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])).drop(there)
