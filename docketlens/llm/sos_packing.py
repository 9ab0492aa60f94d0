"""Packing token sequences online by sum of squares.

Every document becomes its token ids and an end id. Whole windows are cut off a longer document; what is left goes
into the partly filled window whose level keeps the sum over levels of (number of windows at this level) squared
least. The state is the level array with a stack of windows per level, and nothing else: documents are packed
where their text is read, in one pass without a shuffle, and each task has its own array.

A packer holds at most ``MAX_OPEN`` open windows. Above that, and at the end of a task, open windows are merged:
the emptiest give their pieces, cut where needed, to fill the fullest. So a task ends with one padded window
at most, whatever the lengths of the documents.

Defined results:

* NULL and empty texts are one id, the end id. Repeated rows are packed each; the order is that of the table.
* Very long texts are cut into whole windows and a rest. Reruns agree while the table is split alike, as a
  lost task reads its split again.
* ``start``, ``length``, ``ids`` (little-endian 32-bit integers), ``doc_tokens``, ``sequence_id`` and ``offset`` replace
  columns of these names; other kept columns pass unread. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from docketlens.llm.tree_bpe import STEP_BYTES, batches_by_bytes
from docketlens.llm.units import Units
from docketlens.llm.words import free_name

WINDOW = 2048
MAX_OPEN = 4096
# Words that a worker keeps encoded.
CACHED = 500_000
MADE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
# Sequence ids of one task lie together; a task fills fewer windows than this.
TASK_IDS = 1 << 40
ROWS_OUT = 2048

Piece = tuple[object, int, bytes, int]  # row, first id of the document, ids, ids of the document


class Packer:
    """Level array and open windows of one task; full windows come out of ``add`` and ``finish``."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.count = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The level at which a piece adds least to the sum of squares, 0 for a new window; of equals the fullest."""
        from_here = self.count[:self.window - size + 1]
        to_there = self.count[size:].copy()
        change = 2 * (to_there - from_here) + 2
        change[-1] -= 1  # a full window is closed: it adds nothing at its new level
        change[0] = 2 * to_there[0] + 1  # no window leaves level 0
        change[1:][from_here[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, row: object, ids: bytes) -> Iterator[list[Piece]]:
        """Packs one document; yields the windows that it fills."""
        width, total = 4 * self.window, len(ids) // 4
        whole = len(ids) - len(ids) % width
        for at in range(0, whole, width):
            yield [(row, at // 4, ids[at:at + width], total)]
        if whole == len(ids):
            return
        size = total - whole // 4
        level = self.level_for(size)
        pieces = self._take(level) if level else []
        pieces.append((row, whole // 4, ids[whole:], total))
        if level + size == self.window:
            yield pieces
        else:
            self._put(level + size, pieces)
            if self.n_open > self.max_open:
                yield from self._merge()

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._merge()
        for level in list(self.at):
            yield self._take(level)

    def _put(self, level: int, pieces: list[Piece]) -> None:
        self.at.setdefault(level, []).append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def _take(self, level: int) -> list[Piece]:
        pieces = self.at[level].pop()
        if not self.at[level]:
            del self.at[level]
        self.count[level] -= 1
        self.n_open -= 1
        return pieces

    def _merge(self) -> Iterator[list[Piece]]:
        """Fills the fullest windows with the pieces of the emptiest until one is left."""
        spare: list[Piece] = []
        while self.n_open > 1 or (spare and self.n_open):
            level = max(self.at)
            pieces = self._take(level)
            while level < self.window and (spare or self.n_open):
                if not spare:
                    spare = self._take(min(self.at))[::-1]
                row, start, ids, total = spare.pop()
                fits = 4 * (self.window - level)
                pieces.append((row, start, ids[:fits], total))
                level += min(fits, len(ids)) // 4
                if len(ids) > fits:
                    spare.append((row, start + fits // 4, ids[fits:], total))
            if level == self.window:
                yield pieces
            else:
                self._put(level, pieces)
        if spare:
            self._put(sum(len(p[2]) for p in spare) // 4, spare[::-1])


def pack(docs: DataFrame, path: str, cut: str, end_id: int, text: str = "text", keep: list[str] | None = None,
         window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: the columns ``keep`` (all but the text by default) and those of ``MADE``."""
    made = StructType.fromDDL(MADE)
    names = [c for c in (docs.columns if keep is None else keep) if c not in made.names and (keep is not None or c != text)]
    there = free_name(names + made.names, "_there")
    rows = docs.select(F.struct(F.lit(True).alias(there), *[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    out = StructType([rows.schema["row"], *made])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, end = Units.of(path, cut, CACHED), np.array([end_id], "<u4").tobytes()
        packer, number, held = Packer(window, max_open), TaskContext.get().partitionId() * TASK_IDS, []
        kind = None

        def full(windows: Iterator[list[Piece]]) -> None:
            nonlocal number
            for pieces in windows:
                offset = 0
                for row, start, ids, total in pieces:
                    held.append((row, start, len(ids) // 4, ids, total, number, offset))
                    offset += len(ids) // 4
                number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held))
            held.clear()
            types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=out.names)

        for b in (p for whole in batches for p in batches_by_bytes(whole, 1, STEP_BYTES)):
            kind = b.schema.field(0).type
            for row, ids in zip(b.column(0).to_pylist(), units.encode([t or "" for t in b.column(1).to_pylist()])):
                full(packer.add(row, ids + end))
                if len(held) >= ROWS_OUT:
                    yield flush()
        full(packer.finish())
        if held:
            yield flush()

    return rows.mapInArrow(write, out).select("row.*", *made.names).drop(there)
