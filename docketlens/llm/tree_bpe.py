"""BPE encoding and decoding with tree concatenation for long texts.

Texts up to ``LONG`` characters are encoded in place, by units that cannot share a token
(:mod:`docketlens.llm.units`). A longer text is halved until the pieces are short, wherever the halves
fall, and the pieces are encoded in parallel tasks. Pieces are then joined pairwise up the tree: the text around a join
is encoded again in a window that grows until it agrees with the left side on two neighbouring tokens
before the join and with the right side on two after it. The joined ids are the left side's up to the agreement, the
window's in between, and the right side's from there. A sequence of BPE tokens is the encoding of its text
exactly if every pair of neighbours is the encoding of its own text, and every pair of the joined sequence lies
in one of the three exact encodings, so the result equals the encoding of the whole.

Defined results:

* NULL and empty texts have no ids and decode to ''.
* Very long texts are spread over tasks by piece; only the joining of one text is one task.
* Repeated rows give equal results; a long text that occurs often is encoded once.
* ``ids`` and ``decoded`` replace input columns of these names; other columns pass unread. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from docketlens.llm.units import MAX_CACHED, Units

LONG = 65_536
PIECE = 16_384
WINDOW = 64
STEP_BYTES = 2 << 20

Tokens = tuple[np.ndarray, np.ndarray]  # ids, offsets in the whole text


def _agreement(window: Tokens, side: Tokens, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Numbers (in window, in side) of the first of two neighbouring equal tokens that lie in [low, high]."""
    where = {(int(s), int(e), int(i)): n for n, (i, (s, e)) in enumerate(zip(*side)) if low <= s and e <= high}
    ids, spans = window
    inner = range(1, len(ids) - 2)
    for n in reversed(inner) if last else inner:
        one, two = ((int(spans[k][0]), int(spans[k][1]), int(ids[k])) for k in (n, n + 1))
        # Tokens that share a character cannot be told apart by position.
        if one[1] <= two[0] and one in where and where.get(two) == where[one] + 1:
            return n, where[one]
    return None


def join(left: Tokens, right: Tokens, text: str, start: int, at: int, end: int, units: Units) -> Tokens:
    """Tokens of text[start:end] from those of text[start:at] and text[at:end]."""
    size = WINDOW
    while True:
        lo, hi = max(start, at - size), min(end, at + size)
        ids, spans = units.tokens(text[lo:hi])
        window = ids, spans + lo
        a = (0, 0) if lo == start else _agreement(window, left, lo, at, False)
        b = (len(ids), len(right[0])) if hi == end else _agreement(window, right, at, hi, True)
        if a is not None and b is not None and a[0] <= b[0]:
            return tuple(np.concatenate([left[k][:a[1]], window[k][a[0]:b[0]], right[k][b[1]:]]) for k in (0, 1))
        size *= 2


def concatenate(pieces: list[Tokens], text: str, cuts: list[int], units: Units) -> Tokens:
    """Pieces between neighbouring cuts, joined pairwise level by level; offsets in the whole text."""
    while len(pieces) > 1:
        pieces, old = [join(pieces[i], pieces[i + 1], text, cuts[i], cuts[i + 1], cuts[i + 2], units) if i + 1 < len(pieces) else pieces[i]
                       for i in range(0, len(pieces), 2)], len(pieces)
        cuts = [cuts[i] for i in range(0, old, 2)] + [cuts[-1]]
    return pieces[0]


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def batches_by_bytes(b: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    sizes, at = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), 0
    while at < b.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield b.slice(at, n)
        at += n


def encode(docs: DataFrame, path: str, cut: str, text: str = "text", keep: list[str] | None = None,
           long: int = LONG, piece: int = PIECE, cached: int = MAX_CACHED) -> DataFrame:
    """The columns ``keep`` (all by default) with ``ids`` array<int> and ``decoded`` string."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    rows = docs.select(F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    out = StructType([rows.schema["row"], *StructType.fromDDL("ids array<int>, decoded string")])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units.of(path, cut, cached)
        for b in (p for whole in batches for p in batches_by_bytes(whole, 1, STEP_BYTES)):
            ids = units.encode([t or "" for t in b.column(1).to_pylist()])
            decoded = [units.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), pa.array(decoded, pa.string())], names=["row", "ids", "decoded"])

    direct = rows.filter(~is_long).mapInArrow(short, out)

    keyed = rows.filter(is_long).withColumn("key", F.sha2("text", 256))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    # Halving until a piece is short enough gives 2 ** depth pieces of nearly equal length.
    depth = F.ceil(F.log2(F.length("text") / F.lit(piece)))
    count = F.pow(F.lit(2), F.greatest(depth, F.lit(0))).cast("long")
    pieces = (texts.withColumn("count", count).select("key", "text", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("no"))
              .withColumn("start", F.floor(F.col("no") * F.length("text") / F.col("count")).cast("int"))
              .withColumn("end", F.floor((F.col("no") + 1) * F.length("text") / F.col("count")).cast("int"))
              .select("key", "no", "start", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("part"))
              .repartition("key", "no"))
    triple = "ids array<int>, starts array<int>, ends array<int>"

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units.of(path, cut, cached)
        for b in batches:
            for r in b.to_pylist():
                ids, spans = units.tokens(r["part"])
                spans = spans + r["start"]
                yield pa.RecordBatch.from_pylist([r | {"ids": ids.tolist(), "starts": spans[:, 0].tolist(), "ends": spans[:, 1].tolist()}], schema=arrow)

    arrow = pa.schema([("key", pa.string()), ("no", pa.int64()), ("start", pa.int32()), ("part", pa.string()),
                       *[(n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends")]])
    encoded = pieces.mapInArrow(encode_pieces, f"key string, no long, start int, part string, {triple}")

    def merge(table: pa.Table) -> pa.Table:
        units, parts = Units.of(path, cut, cached), sorted(table.to_pylist(), key=lambda r: r["no"])
        whole = "".join(p["part"] for p in parts)
        cuts = [p["start"] for p in parts] + [len(whole)]
        tokens = [(np.array(p["ids"], np.int64), np.stack([np.array(p["starts"], np.int64), np.array(p["ends"], np.int64)], axis=1)) for p in parts]
        ids = concatenate(tokens, whole, cuts, units)[0].tolist()
        return pa.table({"key": [parts[0]["key"]], "ids": pa.array([ids], pa.list_(pa.int32())), "decoded": [units.decode(ids)]})

    joined = encoded.groupBy("key").applyInArrow(merge, "key string, ids array<int>, decoded string")
    return direct.union(keyed.select("row", "key").join(joined, "key").select("row", "ids", "decoded")).select("row.*", "ids", "decoded").drop("_there")
