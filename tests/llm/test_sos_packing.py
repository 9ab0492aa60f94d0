"""Packing: every id in one piece, the level rule by trying all levels, little padding."""

import random
from collections import Counter, defaultdict

import numpy as np

from docketlens.llm import sos_packing
from docketlens.llm.queries import vocabulary
from docketlens.llm.units import Units


def test_level_is_the_one_with_least_squares():
    rng = random.Random(4)
    packer = sos_packing.Packer(window=32, max_open=10**6)
    for n in range(600):
        size = rng.randrange(1, 32)
        before, level = packer.count.copy(), packer.level_for(size)
        sums = {}
        for h in range(0, 33 - size):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 32
                sums[h] = int((after ** 2).sum())
        assert sums[level] == min(sums.values()) and level == max(h for h, v in sums.items() if v == sums[level])
        list(packer.add(n, np.arange(size, dtype="<u4").tobytes()))


def test_open_windows_are_bounded_and_merged():
    packer, full = sos_packing.Packer(window=16, max_open=8), []
    for n in range(500):  # nothing of nine fits with another nine
        full += packer.add(n, np.arange(9, dtype="<u4").tobytes())
        assert packer.n_open <= 9
    full += packer.finish()
    sizes = [sum(len(p[2]) for p in w) // 4 for w in full]
    assert sum(sizes) == 4500 and sum(s < 16 for s in sizes) <= 1
    got = defaultdict(bytes)
    for w in full:
        for row, start, ids, total in sorted(w, key=lambda p: p[1]):
            assert total == 9
    for row, start, ids, _ in sorted((p for w in full for p in w), key=lambda p: (p[0], p[1])):
        assert len(got[row]) == 4 * start
        got[row] += ids
    assert set(got.values()) == {np.arange(9, dtype="<u4").tobytes()} and len(got) == 500


def test_pack_table(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one two three. " * 2000, "été 中文 😀", "don't <|endoftext|> 12"] + [" ".join(rng.choice(["river", "stone", "Walk."]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    rows = [(i, t, "mine", "z", "t") for i, t in enumerate(texts)] + [(3, texts[3], "mine", "z", "t"), (None, None, None, None, None), (None, "x y", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `start` string, `a.b` string, `_there` string").repartition(2)
    path = vocabulary("word_bpe_49k.json")
    pieces = sos_packing.pack(df, path, "bare", 1)
    assert pieces.columns == ["doc_id", "a.b", "_there", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    out, tok = pieces.collect(), Units.of(path, "bare").tokenizer
    want = Counter((d, *np.append(tok.encode(t or "", add_special_tokens=False).ids, 1).tolist()) for d, t, *_ in rows)
    by_seq, whole = defaultdict(list), Counter()
    for r in out:
        assert r.length * 4 == len(r.ids) and r["a.b"] == ("z" if r.doc_id is not None else None)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sos_packing.WINDOW
    assert sum(sum(n for _, n in v) < sos_packing.WINDOW for v in by_seq.values()) <= 2
    got = defaultdict(Counter)
    for r in out:
        got[r.doc_id, r.doc_tokens][r.start, bytes(r.ids)] += 1
    for (d, total), parts in got.items():
        copies = sum(n for (s, _), n in parts.items() if s == 0)
        assert sum(len(i) // 4 * n for (_, i), n in parts.items()) == total * copies
        for ids in [w for w in want if w[0] == d and len(w) - 1 == total]:
            raw = np.array(ids[1:], "<u4").tobytes()
            assert all(raw[4 * s:4 * s + len(i)] == i for s, i in parts)
            whole[ids] += copies
    assert whole == want
    assert sos_packing.pack(df.limit(0), path, "bare", 1).count() == 0
