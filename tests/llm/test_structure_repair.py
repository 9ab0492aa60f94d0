"""Structure repair against a plain dynamic program, whatever the chunks."""

import hashlib
import random
import re
import zlib

import pytest

from docketlens.llm import structure_repair

CHAR = re.compile(r"[^\x20\x09-\x0D]")
AFTER = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
NAME = {"u": "user", "a": "assistant"}


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of rows (turn, role, text) by trying every edit in each state."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, r, x in rows:
        chars = CHAR.findall(x)
        faults.append("blank" if not chars else "duplicate" if (r, x) in seen else "truncated" if chars[-1] not in ".!?" else None)
        seen.add((r, x))
    best = {"E": (0, "", ())}

    def offer(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value
            return True

    def inserted(table):
        grew = True
        while grew:
            grew = False
            for s, (c, a, out) in list(table.items()):
                free = "a" if s == "U" else "u"
                grew |= bool(offer(table, AFTER[s, free], (c + 5, a + "I", out + ((NAME[free], ""),))))
        return table

    for (_, r, x), fault in zip(rows, faults):
        nxt = {}
        for s, (c, a, out) in inserted(best).items():
            offer(nxt, s, (c + 2, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            late, free = 5 * (fault == "truncated"), "a" if s == "U" else "u"
            if (s, r[:1]) in AFTER:
                offer(nxt, AFTER[s, r[:1]], (c + late, a + "K", out + ((r, x),)))
            offer(nxt, AFTER[s, free], (c + 1 + late, a + "R", out + ((NAME[free], x),)))
        best = nxt
    cost, audit, out = min((best[s] for s in "EA" if s in inserted(best)), key=lambda v: v[:2])
    turns, initials = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


def table():
    rng = random.Random(1)
    texts = ["a.", "b?", "c", "d!", "", None, " \n", "e. ", "f;", "g.\n", "h", "long " * 9 + "x.", "long " * 9 + "y."]
    rows = [(c or None, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "u", "sys", ""]), rng.choice(texts))
            for c in range(60) for t in range(rng.choice([1, 2, 3, 7, 20]))]
    # Long runs of one role never forget their end; copies; a very long text.
    rows += [(500, i, "user", f"q{i}?") for i in range(60)] + [(501, i, "assistant", f"q{i}?") for i in range(61)] + [(502, i, "user", "same.") for i in range(40)]
    rows += [(503, i, rng.choice(["user", "assistant"]), f"x{i}" + rng.choice(["", ".", "!"])) for i in range(50)] + [(504, i, "system", f"x{i}.") for i in range(33)]
    return rows + [(505, 0, "user", "word " * 100_000 + "."), rows[0], (None, None, None, None)]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_equals_the_plain_program(spark, bits):
    rows = table()
    df = spark.createDataFrame([(*r, "mine", "z") for r in rows], "conv_id long, turn long, role string, text string, edits string, `a.b` string").repartition(3)
    want = {}
    for c, *r in rows:
        want.setdefault(c, []).append(r)
    repaired = structure_repair.repair(df, chunk_bits=bits)
    assert {r.conv_id: tuple(r)[1:] for r in structure_repair.summaries(repaired).collect()} == {c: plain(v) for c, v in want.items()}
    assert repaired.filter("`a.b` = 'z'").count() == len(rows)


def test_shapes_are_few_and_runs_meet():
    assert len(structure_repair.machine().shapes) < 64
    symbols = bytes(random.Random(2).choice([2, 4, 6, 7, 1, 0]) for _ in range(500))
    shape, path = structure_repair.backward(symbols, 0)
    other, old = structure_repair.backward(symbols, 1)
    again, fixed = structure_repair.backward(symbols, 0, old)
    assert fixed == path and again in (-1, shape) and (again == shape or other == shape)


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, random.Random(c).choice(["user", "assistant"]), f"turn {t}.") for c in range(120) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("user" if code == 4 else role or " "), ("" if code == 1 else re.sub("[.!?]", "", text or " ") if code == 2 else text or " ")
        want[c] += [(t, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = structure_repair.summaries(structure_repair.repair(structure_repair.damage(df), "absent"), "absent")
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == {c: plain(v) for c, v in want.items()}
    alone = spark.createDataFrame([(gone, 0, "user", "x.")], df.schema)
    (r,) = structure_repair.summaries(structure_repair.repair(structure_repair.damage(alone), "absent"), "absent").collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert structure_repair.summaries(structure_repair.repair(structure_repair.damage(df.limit(0)), "absent"), "absent").count() == 0
