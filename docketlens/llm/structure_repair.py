"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

The turns of a conversation are edited at least cost so that the initials of their roles read (s?(ua)+)?. Edits: Keep 0,
Rerole to user or assistant 1, Delete 2 (forced for blank turns and duplicates), Insert an empty turn of user or
assistant 5; a truncated turn that stays costs 5 more. Among the cheapest repairs, the one whose string of edit
initials is least in ASCII order is taken.

Turns are sorted by range over all tasks, so a long conversation lies in several tasks; a chunk is up to
``CHUNK`` neighbouring turns of one conversation. A turn is one byte there: what it may become. Costs to the end are
computed from the right, one vector over the four automaton states before each turn. Vectors that differ by a constant
lead to the same decisions, so only their differences (the shape) are kept; few shapes exist.

1. Every chunk starts from a speculative vector (zeros; the true one at a conversation's end).
2. Fix-up passes: a chunk whose right neighbour found another shape than it started from runs again, and stops where its
   shapes meet the stored ones: from there on the vectors differ only by a constant.
3. If chunks still change after ``FIXUPS`` passes (long runs of one role never forget their end), those
   conversations get one more pass that starts each chunk from every shape; the answers are chained from the right.
4. The stitched costs drive the trace from the left: in each state the least edit initial whose cost is optimal. A chunk
   first tells its exit state for each entry state; these are chained, then every chunk writes its edits.

Chains hold a few bytes per chunk. No turn is gathered: duplicates are found by an aggregate over (conversation, role,
digest of the text), and only first positions are joined back.

Defined results:

* Order: turn (NULL first), role, text (its first 32 characters, then its digest); equal rows in table order.
* NULL roles and texts are one space. A NULL ``conv_id`` is one conversation. A turn is blank without a character outside
  U+0020 and U+0009 to U+000D, else a duplicate if role and text occur before it, else truncated if its last such character is not one of ``.!?``.
* Rows whose ``absent`` column is true only name their conversation and its place in a chunk; insertions at the end may stand on
  one. Very long texts are only digested and passed on.
* ``pos``, ``fault``, ``edits`` and ``repaired`` replace columns of these names. An empty table gives an empty result.
* Sorted turns and chunks are written once in the shared checkpoint folder, so reruns of lost tasks see the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketlens.llm.words import SPACE, shuffle_partitions
from docketlens.session import checkpoint_dir

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CHUNK_BITS = 16
ROWS_OUT = 20_000
FIXUPS = 3
START, SYSTEM, USER, ANSWER = range(4)
INITIALS = "sua"
# The state behind a turn with this initial, where the pattern allows it.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ANSWER, "u"): USER, (USER, "a"): ANSWER}
# The initial that an inserted or reroled turn has in each state.
FREE = {START: "u", SYSTEM: "u", ANSWER: "u", USER: "a"}
NAMES = {"u": "user", "a": "assistant"}
# Symbols: 0 absent, 1 must go, then two for each initial (s, u, a, other): whole or truncated.
ABSENT, MUST_GO, FIRST_KEPT = 0, 1, 2
N_SYMBOLS = FIRST_KEPT + 2 * (len(INITIALS) + 1)
ZEROS = (0, 0, 0, 0)


def _closed(costs: list[float]) -> tuple:
    """Costs with any number of insertions first."""
    costs, old = list(costs), None
    while old != costs:
        old = list(costs)
        for s in range(4):
            costs[s] = min(costs[s], INSERT + costs[AFTER[s, FREE[s]]])
    return tuple(costs)


END = _closed([0, float("inf"), float("inf"), 0])


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn, without insertions."""
    if symbol == ABSENT:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol >= FIRST_KEPT:
        which, truncated = divmod(symbol - FIRST_KEPT, 2)
        initial = (INITIALS + "?")[which]
        if (state, initial) in AFTER:
            out.append(("K", KEEP + TRUNCATED * truncated, AFTER[state, initial]))
        out.append(("R", REROLE + TRUNCATED * truncated, AFTER[state, FREE[state]]))
    return out


def _before(symbol: int, after: tuple) -> tuple:
    return _closed([min(c + after[n] for _, c, n in _choices(symbol, s)) for s in range(4)])


class _Machine:
    """All shapes, the shape before each symbol, and the edits in each state."""

    def __init__(self):
        self.shapes, queue, step = {END: 0, ZEROS: 1}, [END, ZEROS], {}
        for shape in queue:
            for symbol in range(N_SYMBOLS):
                costs = _before(symbol, shape)
                found = tuple(c - min(costs) for c in costs)
                if found not in self.shapes:
                    self.shapes[found] = len(self.shapes)
                    queue.append(found)
                step[self.shapes[shape], symbol] = self.shapes[found]
        self.step = [[step[h, y] for y in range(N_SYMBOLS)] for h in range(len(queue))]
        # (edits, next state, cost, roles made: None for the turn's own)
        self.act = [[[self._edits(y, shape, s) for s in range(4)] for y in range(N_SYMBOLS)] for shape in queue]
        self.rest = [self._inserts(s) for s in range(4)]

    @staticmethod
    def _edits(symbol: int, after: tuple, state: int) -> tuple[str, int, int, tuple]:
        costs, edits, paid, made = _before(symbol, after), "", 0, ()
        while True:
            best = {e: (c, n) for e, c, n in _choices(symbol, state) if c + after[n] == costs[state]}
            if "" in best:
                return "", state, 0, ()
            if "D" not in best and INSERT + costs[AFTER[state, FREE[state]]] == costs[state]:
                edits, paid, made, state = edits + "I", paid + INSERT, made + ((NAMES[FREE[state]], False),), AFTER[state, FREE[state]]
                continue
            edit = min(best)
            role = {"K": ((None, True),), "R": ((NAMES[FREE[state]], True),), "D": ()}[edit]
            return edits + edit, best[edit][1], paid + best[edit][0], made + role

    @staticmethod
    def _inserts(state: int) -> tuple[str, int, tuple]:
        edits, made = "", ()
        while state not in (START, ANSWER):
            made, edits, state = made + ((NAMES[FREE[state]], False),), edits + "I", AFTER[state, FREE[state]]
        return edits, INSERT * len(edits), made


@cache
def machine() -> _Machine:
    return _Machine()


def backward(symbols: bytes, right: int, path: bytes | None = None) -> tuple[int, bytes]:
    """(shape before the first turn, shape behind each turn); with an older path, only as far as shapes differ."""
    step, shape, out = machine().step, right, bytearray(path or len(symbols))
    for i in range(len(symbols) - 1, -1, -1):
        if path is not None and path[i] == shape:
            return -1, bytes(out)
        out[i] = shape
        shape = step[shape][symbols[i]]
    return shape, bytes(out)


def exits(symbols: bytes, path: bytes) -> bytes:
    """The state behind a chunk for each of the four states before it."""
    act, out = machine().act, []
    for state in range(4):
        for y, h in zip(symbols, path):
            state = act[h][y][state][1]
        out.append(state)
    return bytes(out)


def trace(symbols: bytes, path: bytes, state: int, last: bool) -> list[tuple[str, int, tuple]]:
    """(edits, cost, turns made) of each turn; what the end needs is added to the last one."""
    act, out = machine().act, []
    for y, h in zip(symbols, path):
        edits, state, cost, made = act[h][y][state]
        out.append((edits, cost, made))
    if last:
        edits, cost, made = machine().rest[state]
        out[-1] = (out[-1][0] + edits, out[-1][1] + cost, out[-1][2] + made)
    return out


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _solved(chunks: DataFrame, folder: str) -> DataFrame:
    """(conv, chunk, entry state, last, pos, symbols, path) with true shapes for every chunk."""
    slim = chunks.select("conv", "chunk")
    per = slim.groupBy("conv").agg(F.count("*").alias("n"), F.max("chunk").alias("last_chunk"), F.min("chunk").alias("first_chunk"))
    joined = chunks.join(per.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")

    def first_run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["right"] = [0 if c == e else 1 for c, e in zip(f["chunk"], f["last_chunk"])]
            runs = [backward(s, r) for s, r in zip(f["symbols"], f["right"])]
            f["left"], f["path"] = [r[0] for r in runs], [r[1] for r in runs]
            yield f

    kept = "conv {0}, chunk long, pos array<long>, symbols binary, n long, last_chunk long, first_chunk long".format(
        chunks.schema["conv"].dataType.simpleString())
    state = _stored(joined.select("conv", "chunk", "pos", "symbols", "n", "last_chunk", "first_chunk")
                    .mapInPandas(first_run, f"{kept}, right int, left int, path binary"), folder, "run")
    alone, parts = state.filter("n = 1"), state.filter("n > 1")
    if parts.limit(1).count() == 0:
        return alone.withColumn("entry", F.lit(START))
    # Neighbours: the chunks of a conversation are ranked on a table without their turns.
    rank = F.expr("row_number() OVER (PARTITION BY conv ORDER BY chunk)")
    ranked = parts.select("conv", "chunk").withColumn("no", rank).select(F.col("conv").alias("rc"), F.col("chunk").alias("rk"), "no")
    parts = parts.join(ranked, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("chunk") == F.col("rk"))).drop("rc", "rk")
    fields = f"{kept}, right int, left int, path binary, no int"

    def asked(df: DataFrame) -> DataFrame:
        """With ``found``: what the right neighbour has as its left shape."""
        right = df.select(F.col("conv").alias("rc"), (F.col("no") - 1).alias("rn"), F.col("left").alias("found"))
        return df.join(right, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("no") == F.col("rn")), "left").drop("rc", "rn").withColumn(
            "found", F.coalesce("found", "right"))

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, (s, r, g, p) in enumerate(zip(f["symbols"], f["right"], f["found"], f["path"])):
                if r != g:
                    left, path = backward(s, int(g), p)
                    f.at[i, "path"] = path
                    f.at[i, "right"] = g
                    if left >= 0:
                        f.at[i, "left"] = left
            yield f.drop(columns="found")

    parts = _stored(parts, folder, "parts-0")
    for k in range(FIXUPS):
        wanted = asked(parts)
        if wanted.filter("found <> right").limit(1).count() == 0:
            break
        parts = _stored(wanted.select(*parts.columns, "found").mapInPandas(again, fields), folder, f"parts-{k + 1}")
    else:
        if asked(parts).filter("found <> right").limit(1).count():
            parts = _stored(_from_every_shape(parts, again, fields), folder, "parts-every")

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"conv": f["conv"], "no": f["no"], "out": [exits(s, p) for s, p in zip(f["symbols"], f["path"])]})

    conv = f"conv {chunks.schema['conv'].dataType.simpleString()}"
    told = parts.select("conv", "no", "symbols", "path").mapInPandas(tell, f"{conv}, no int, out binary")
    entries = told.groupBy("conv").applyInPandas(lambda f: _chained(f, "out", "entry", START, False), f"{conv}, no int, entry int")
    entries = entries.select(F.col("conv").alias("rc"), F.col("no").alias("rn"), "entry")
    many = parts.join(entries, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("no") == F.col("rn"))).drop("rc", "rn", "no")
    return alone.withColumn("entry", F.lit(START)).unionByName(many)


def _chained(f: pd.DataFrame, table: str, out: str, start: int, from_right: bool) -> pd.DataFrame:
    """Applies the chunks' tables one after the other: a few bytes per chunk of one conversation."""
    f = f.sort_values("no", ascending=not from_right)
    value, got = start, []
    for t in f[table]:
        got.append(value)
        value = t[value]
    return pd.DataFrame({"conv": f["conv"], "no": f["no"], out: got})


def _from_every_shape(parts: DataFrame, again, fields: str) -> DataFrame:
    """The chunks of all conversations in ``parts`` from their true right shapes."""
    conv = f"conv {parts.schema['conv'].dataType.simpleString()}"

    def every(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = np.array(machine().step, np.uint8)
        for f in frames:
            tables = []
            for s in f["symbols"]:
                now = np.arange(len(step), dtype=np.uint8)
                for y in reversed(s):
                    now = step[now, y]
                tables.append(now.tobytes())
            yield pd.DataFrame({"conv": f["conv"], "no": f["no"], "table": tables})

    told = parts.select("conv", "no", "symbols").mapInPandas(every, f"{conv}, no int, table binary")
    true = told.groupBy("conv").applyInPandas(lambda f: _chained(f, "table", "found", 0, True), f"{conv}, no int, found int")
    true = true.select(F.col("conv").alias("rc"), F.col("no").alias("rn"), "found")
    joined = parts.join(true, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("no") == F.col("rn"))).select(*parts.columns, "found")
    return joined.mapInPandas(again, fields)


def repair(turns: DataFrame, absent: str | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The rows of (conv_id, turn, role, text, ...) with their place and their repair.

    ``pos`` orders the rows of a conversation; ``fault`` is blank, duplicate, truncated or NULL; ``edits`` are the edit initials
    at the row (insertions before it, its own, after the last row also those behind it); ``cost`` is their cost;
    ``repaired`` are the turns that come out there, array<struct<role, text>>. Absent rows have no edit of their own.
    """
    spark = turns.sparkSession
    folder = f"{checkpoint_dir(spark)}/repair-{uuid4().hex}"
    made = ("pos", "fault", "edits", "cost", "repaired")
    names = [c for c in turns.columns if c not in made]
    gone = F.coalesce(F.col(f"`{absent}`"), F.lit(False)) if absent else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    base = turns.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("conv_id").alias("conv"), F.col("turn").alias("at"), role.alias("said_by"),
                        F.substring(text, 1, 32).alias("head"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("nth"),
                        gone.alias("gone"), text.rlike(f"[^{SPACE}]").alias("full"),
                        text.rlike(rf"[.!?][{SPACE}]*\z").alias("ended"), F.substring(role, 1, 1).alias("initial"))
    order = ["conv", "at", "said_by", "head", "digest", "nth"]
    sliced = base.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    rows = _stored(sliced.withColumn("pos", F.monotonically_increasing_id()), folder, "turns")

    firsts = rows.filter("full AND NOT gone").groupBy("conv", "said_by", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.coalesce(*[F.when(F.col("initial") == c, F.lit(i)) for i, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    symbol = (F.when(F.col("gone"), ABSENT).when(~F.col("full") | F.col("first").isNull(), MUST_GO)
              .otherwise(FIRST_KEPT + 2 * initial + F.when(F.col("ended"), 0).otherwise(1)))
    marked = rows.select("conv", "pos", "gone", "full", "ended", "initial").join(firsts, "pos", "left").select(
        "conv", F.shiftright("pos", chunk_bits).alias("chunk"), F.struct("pos", symbol.cast("int").alias("symbol")).alias("turn"))
    listed = marked.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # A byte per turn: two hexadecimal digits each.
    packed = F.unhex(F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["symbol"]), 2, "0")), ""))
    chunks = _stored(listed.select("conv", "chunk", F.col("turns.pos").alias("pos"), packed.alias("symbols")), folder, "chunks")

    def edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []

        def out() -> pd.DataFrame:
            got = pd.DataFrame(held, columns=["pos", "must_go", "edits", "cost", "made"])
            held.clear()
            return got

        for f in frames:
            for pos, symbols, path, entry, last in zip(f["pos"], f["symbols"], f["path"], f["entry"], f["last"]):
                for at, y, (edits, cost, turns_made) in zip(pos, symbols, trace(symbols, path, int(entry), bool(last))):
                    held.append((at, y == MUST_GO, edits, cost, [{"role": r, "own": o} for r, o in turns_made]))
                if len(held) >= ROWS_OUT:
                    yield out()
        if held:
            yield out()

    solved = _solved(chunks, folder).select("pos", "symbols", "path", "entry", (F.col("chunk") == F.col("last_chunk")).alias("last"))
    edits = solved.mapInPandas(edit, "pos long, must_go boolean, edits string, cost long, made array<struct<role:string,own:boolean>>")
    fault = (F.when(F.col("gone"), None).when(~F.col("full"), "blank").when(F.col("must_go"), "duplicate").when(~F.col("ended"), "truncated"))
    own = F.coalesce(F.col("row.text"), F.lit(" "))
    repaired = F.transform("made", lambda m: F.struct(F.coalesce(m["role"], F.col("said_by")).alias("role"), F.when(m["own"], own).otherwise("").alias("text")))
    return rows.join(edits, "pos").select("row.*", "pos", fault.alias("fault"), "edits", "cost", repaired.alias("repaired"))


def summaries(repaired: DataFrame, absent: str | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit and a digest of the repaired turns.

    A digest over a conversation is one sequence: its rows come sorted to one task, which reads them as a stream and
    holds one batch and the audit string.
    """
    gone = F.coalesce(F.col(f"`{absent}`"), F.lit(False)) if absent else F.lit(False)
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    rows = repaired.select("conv_id", "pos", gone.alias("gone"), F.col("turn").cast("decimal(20,0)").cast("string").alias("turn"),
                           F.substring(F.coalesce("role", F.lit(" ")), 1, 1).alias("initial"), "fault", "edits", "cost", lines.alias("lines"))
    rows = rows.repartition(shuffle_partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, some, kind = None, None, [], None

        def done() -> None:
            low, high, distinct = held["low"], held["high"], held["distinct"]
            held["gaps"] = high - low + 1 - distinct if distinct else 0
            some.append([conv, *[held[c] for c in counts], "".join(held["audit"]), held["sha"].hexdigest()])

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*some))
            some.clear()
            types = [kind] + [pa.int64()] * len(counts) + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *counts, "audit", "repaired_sha256"])

        for b in batches:
            kind = b.schema.field(0).type
            for r in b.to_pylist():
                if held is None or r["conv_id"] != conv:
                    if held is not None:
                        done()
                    conv = r["conv_id"]
                    held = {c: 0 for c in counts} | {"low": None, "high": None, "distinct": 0, "before": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                held["cost"] += r["cost"]
                held["audit"].append(r["edits"])
                for line in r["lines"]:
                    held["sha"].update((("\n" if held["any"] else "") + line).encode())
                    held["any"] = True
                if r["gone"]:
                    continue
                if r["turn"] is not None:
                    turn = int(r["turn"])
                    held["distinct"] += turn != held["high"]
                    held["low"], held["high"] = turn if held["low"] is None else held["low"], turn
                if held["before"] is not None and held["before"] + r["initial"] not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["before"] = r["initial"]
                if r["fault"]:
                    held[r["fault"]] += 1
            if len(some) >= 4096:
                yield rows_out()
        if held is not None:
            done()
        if some:
            yield rows_out()

    kind = repaired.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, absent): one turn in twenty each is dropped, emptied, robbed of its end marks, said twice or given to the user."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(code.isin(0, 1), "").when(code == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = turns.select("conv_id", "turn", F.when(code == 0, "").when(code == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
                       (code == 0).alias("absent"), F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")
