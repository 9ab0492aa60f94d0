"""Every operator against a plain program, on odd rows: NULLs, empty and long texts, ties, repeats, clashing names."""

import hashlib
import io
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlens.llm import (chat_format, components, edit_embedding, mixing, quality_rules, secret_index, simhash_variants, token_frames,
                            tree_bpe, url_validity, vector_packing)
from docketlens.llm.queries import vocabulary
from docketlens.llm.units import Units

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("spans", "size", "key", "shard", "slot", "ids", "decoded", "_row", "row", "fp", "n_words", "kept", "copies", "group_key")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
RNG = random.Random(3)
PROSE = " ".join(RNG.choice(["one", "two", "river", "stone", "walk", "under", "light", "seven", "cold", "word"]) + str(RNG.randrange(99)) for _ in range(120)) + "."
TEXTS = [None, "", " \n\t", PROSE, PROSE, PROSE + " tail.", "password: hunter2hunter AKIA" + "A" * 18 + " " + "0af3" * 8,
         "a | b | c | d | e\n" * 30, "été 中文 😀 " * 60, "x" * 3000, "token=abc secret = 'longer.value' token: ghijkl", "w " * 2000, PROSE[::-1]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None][i % 3], len(t or "")) + ("x",) * len(CLASH) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[8], (None, PROSE, "en", "a", 5) + ("x",) * len(CLASH), (None, None, None, None, None) + (None,) * len(CLASH)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_quality_counts(docs, empty):
    def expect(t):
        w = WORD.findall(t)
        wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        c = Counter(wins)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                len({j for i, x in enumerate(wins) if c[x] > 1 for j in (i, i + 1, i + 2)}))

    out = quality_rules.judge(docs)
    got = Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == Counter((d, t, *expect(t or "")) for d, t in plain(docs))
    assert [r for r in out.collect() if r.text == PROSE and not r.kept] == []
    assert quality_rules.clean(docs).columns == docs.columns and quality_rules.clean(empty).count() == 0
    kept = quality_rules.clean(docs).collect()
    assert all(r.n_chars == len(r.text) for r in kept) and not any("| b |" in r.text for r in kept)


def test_quality_many_repeats(spark):
    words = [RNG.choice("abcdefgh") for _ in range(600)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    wins = [tuple(words[i:i + 3]) for i in range(598)]
    c = Counter(wins)
    want = len({j for i, x in enumerate(wins) if c[x] > 1 for j in (i, i + 1, i + 2)})
    assert quality_rules.judge(df).first().n_repeat_words == want


def test_packing(docs, empty):
    out = vector_packing.pack(vector_packing.text_sizes(docs), 3, "doc_id").collect()
    assert len(out) == docs.count() and {r.shard for r in out} <= {0, 1, 2}
    homes = {}
    for r in out:
        homes.setdefault(r.text or "", set()).add(r.shard)
    assert all(len(h) == 1 for t, h in homes.items())
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert vector_packing.pack(vector_packing.text_sizes(empty), 3, "doc_id").count() == 0


def test_packing_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " + "y" * (i % 50)) for i in range(3000)]
    df = vector_packing.text_sizes(spark.createDataFrame(rows, "doc_id long, text string")).drop("text")
    out = vector_packing.pack(df, 8, "doc_id").groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert len(out) == 8 and max(r.b for r in out) < 1.05 * min(r.b for r in out)


def test_trigram_queries_hold_for_matches():
    probes = {"assign": "API_KEY = 'abcdef'", "access": "AKIA" + "Z" * 20, "pem": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a" * 36,
              "slack": "xoxb-" + "1" * 12, "jwt": "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "map_key": "AIza" + "d" * 35, "login_url": "https://u:p@h"}
    for rule in secret_index.RULES:
        q = secret_index.trigram_query(rule)
        if rule.kind == "hex":
            assert q is None
            continue
        text = ("zz " + probes[rule.kind] + " zz").encode()
        grams = sorted({g for c in q for g in c})
        index = secret_index.postings([b"nothing", text, b""], grams)
        assert secret_index.candidates(q, index).tolist() == [1], rule.kind
    for pattern in ("(ab|cd)+efg", "a?bcde", "[xy]zz{2,}w", "(?:foo|ba[rz])qu+x", "(abc)*d", "x{3}|yyyy"):
        q = secret_index.trigram_query(secret_index.Rule("t", pattern))
        for s in ("abefg", "cdabefg", "bcde", "abcde", "xzzzw", "fooquux", "bazqux", "d", "abcd", "xxx", "yyyy"):
            if re.search(pattern, s) and q is not None:
                assert any(all(g in s.encode() for g in c) for c in q), (pattern, s)


def test_secrets(docs, empty):
    base = {r.kind: r for r in secret_index.BASE}

    def expect(t):
        out = []
        for o, (k, r) in enumerate(base.items()):
            out += [(m.start(), o, f"{k}:{m.start()}:{m.end()}") for m in re.finditer(r.pattern, t, r.flags) if len(m.group(r.group)) >= r.min_chars]
        return [x[2] for x in sorted(out)]

    out = secret_index.scan(docs, keep=["doc_id", "text", "spans", "row"])
    got = Counter((r.doc_id, r.text, tuple(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in base)) for r in out.collect())
    assert got == Counter((d, t, tuple(expect(t or ""))) for d, t in plain(docs))
    clean = secret_index.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count() and secret_index.redact(empty).count() == 0
    assert not any("hunter2" in (r.text or "") or "AKIAA" in (r.text or "") for r in clean.collect())
    assert clean.filter("text IS NULL").count() == docs.filter("text IS NULL").count()


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    assert all(sum(r.taken for r in v) == round(v[0].target) for v in by.values())
    total = sum(r.size for r in out)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, out))
    rows = mixing.mixed(docs).select("text", "doc_id", "n_chars").collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == sum(r.taken for r in out)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_url_intervals(spark):
    log = [("l", "block", "domain", "bad.com", "add", "2024-01-05", 0), ("l", "block", "domain", "bad.com", "add", "2024-01-07", 0),
           ("l", "block", "domain", "bad.com", "remove", "2024-02-01", 0), ("l", "block", "domain", "bad.com", "add", "2024-03-01", 0),
           ("l", "block", "domain", "bad.com", "remove", "2024-03-01", 1), ("t", "allow", "prefix", "www.bad.com/ok", "add", "2024-01-01", 0),
           ("l", None, "domain", "bad.com", "add", "2024-01-01", 0)]
    entries = spark.createDataFrame(log, "list string, action string, kind string, value string, change string, day string, seq int").withColumn("day", F.to_date("day"))
    rows = [(1, "http://www.bad.com/x", "2024-01-04"), (2, "http://www.bad.com/x", "2024-01-05"), (3, "http://bad.com", "2024-01-31"), (4, "http://bad.com", "2024-02-01"),
            (5, "http://bad.com", "2024-03-02"), (6, "https://www.bad.com/ok/p?q", "2024-01-10"), (7, "https://www.bad.com/okay", "2024-01-10"), (8, None, "2024-01-10"),
            (9, "nonsense", "2024-01-10"), (10, "http://bad.com/", None), (11, "http://notbad.com/", "2024-01-10"), (2, "http://www.bad.com/x", "2024-01-05")]
    caps = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, fetched_on string, verdict string").withColumn("fetched_on", F.to_date("fetched_on"))
    got = Counter((r.page_id, r.verdict) for r in url_validity.judge(caps, entries).collect())
    assert got == Counter([(1, "none"), (2, "block"), (2, "block"), (3, "block"), (4, "none"), (5, "none"), (6, "allow"), (7, "block"), (8, "none"), (9, "none"), (10, "none"), (11, "none")])
    assert url_validity.judge(caps, entries.limit(0)).filter("n_hits > 0").count() == 0 and url_validity.judge(caps.limit(0), entries).count() == 0


def test_edit_embedding(docs, empty):
    out = edit_embedding.neighbours(docs).collect()
    rows = sorted(plain(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter((d, hashlib.sha256(edit_embedding.edited(t or "", rows[(i + 1) % len(rows)][1] or "").encode()).hexdigest()) for i, (d, t) in enumerate(rows))
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == want
    prints = {}
    for (d, t), f in [((r.doc_id, r.text), r.fingerprint) for r in edit_embedding.fingerprints(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text")).select("doc_id.*", "fingerprint").collect()]:
        prints.setdefault(t or "", set()).add(f)
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {"0:"}
    assert edit_embedding.neighbours(empty).count() == 0
    # The walk against its definition, one character at a time.
    w, t = edit_embedding.walk(), PROSE[:200]
    at, path = 0, [0]
    for c in t:
        at += int(w.stay[(at % edit_embedding.PERIOD) * 256 + ((ord(c) * 2654435761 % 2**32) >> 24)])
        path.append(at)
    codes = np.array([(ord(c) * 2654435761 % 2**32) >> 24 for c in t], np.uint8)
    assert w._paths([codes])[0].tolist() == path
    near, far = w.embed([PROSE, PROSE.replace("river", "rivers", 1), PROSE[::-1]])[1:]
    own = w.embed([PROSE])[0]
    assert w.likeness(own, near) > 0.6 > w.likeness(own, far)


def test_edit_similar(spark):
    base = ["".join(RNG.choice("abcdefgh ") for _ in range(4000)) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)] + [(10 + i, b[:-3] + "zzz") for i, b in enumerate(base)]
    prints = edit_embedding.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.a, r.b) for r in edit_embedding.similar(prints).collect()}
    by = {r.doc_id: r.fingerprint for r in prints.collect()}
    for i in range(6):
        a, b = sorted((by[i], by[10 + i]))
        assert a == b or (b, a) in found


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x", "</s>[INST] ok [/INST]", "", None, "a\nb", "<|turn|><<SYS>>\\", "<", "[\\\\INST]"]
    rows = [(c, t, RNG.choice(["user", "assistant", "system", "a<|b", None]), RNG.choice(texts)) for c in range(40) for t in range(RNG.randrange(1, 7))]
    rows += [rows[0], (None, None, None, None), (None, 2, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat_format.format_chats(df)
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat_format.parse_chats(formatted).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == {c: (v, "".join(t for r, t in v if r == "assistant")) for c, v in want.items()}
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "bare"), ("byte_bpe_50k.json", "led")])
def test_units_and_tree_equal_whole_encoding(name, cut):
    units = Units.of(vocabulary(name), cut)
    pools = [list("abcdeilnorst'' \n\n  .,!?12") + list("éßñİΣ\x1c\x1f\x85\xa0 　​᠎中文😀") + ["'s", "'ll", "<|endoftext|>", "the ", "ing"],
             list("ab"), list("!'-.s"), ["the", "ing", "😀", "é"], ["<|endoftext|>", "x", "<|"]]
    for k in range(400):
        t = "".join(RNG.choices(pools[k % len(pools)], k=RNG.choice([0, 1, 30, 700])))
        whole = units.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(units.encode([t])[0], "<u4").tolist() == whole
        n = RNG.choice([1, 2, 3, 8])
        cuts = [i * len(t) // n for i in range(n + 1)]
        parts = [(i, s + a) for a, b in zip(cuts, cuts[1:]) for i, s in [units.tokens(t[a:b])]]
        assert tree_bpe.concatenate(parts, t, cuts, units)[0].tolist() == whole


def test_tree_bpe_table(docs, empty):
    out = tree_bpe.encode(docs, vocabulary("word_bpe_49k.json"), "bare", keep=["doc_id", "text", "ids", "row"], long=500, piece=120).collect()
    tok = Units.of(vocabulary("word_bpe_49k.json"), "bare").tokenizer
    want = Counter()
    for d, t in plain(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d, t, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in out) == want
    assert tree_bpe.encode(empty, vocabulary("word_bpe_49k.json"), "bare").count() == 0


def test_frames(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_frames.write_tokens(docs, folder, vocabulary("byte_bpe_50k.json"), "led", files=3)
    out = token_frames.read_tokens(spark, folder, manifest).collect()
    tok, at, want = Units.of(vocabulary("byte_bpe_50k.json"), "led").tokenizer, 0, Counter()
    for d, t in sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want[d, at, len(ids), np.array(ids, "<u4").tobytes()] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in out) == want
    some = token_frames.read_tokens(spark, folder, manifest, wanted=[9]).collect()
    assert [r.doc_id for r in some] == [9]
    none = token_frames.write_tokens(empty, folder + "0", vocabulary("byte_bpe_50k.json"), "led", files=3)
    assert none == [] and token_frames.read_tokens(spark, folder, none).count() == 0


def test_frame_reader_opens_only_what_it_needs(monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_BYTES", 64)
    out = io.BytesIO()
    writer = token_frames.FrameWriter(out)
    ids = {i: np.arange(i * 5, dtype="<u4").tobytes() for i in range(1, 20)}
    for i, b in ids.items():
        writer.add(i, b)
    writer.close()
    reader = token_frames.FrameReader(io.BytesIO(out.getvalue()))
    assert reader.ids(2) == ids[3] and reader.opened == 1
    assert all(reader.ids(k) == ids[d] for k, d in enumerate(reader.doc_ids))
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(ids.values())
    broken = bytearray(out.getvalue())
    broken[12] ^= 1
    with pytest.raises(Exception):
        token_frames.FrameReader(io.BytesIO(bytes(broken))).ids(0)


def brute_components(rows):
    import xxhash

    def fp(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hs = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min((d for (d, _), x in zip(rows, root) if x == r and d is not None), default=None) for r in root}
    return fps, [least[r] for r in root]


def test_simhash(docs, empty):
    rows = plain(docs)
    fps, comps = brute_components(rows)
    want = Counter((d, format(f, "016x"), c) for (d, _), f, c in zip(rows, fps, comps))
    out = simhash_variants.near_duplicates(docs).select("doc_id", simhash_variants.hex_fingerprint(F.col("fp")).alias("f"), "component_id")
    assert Counter(map(tuple, out.collect())) == want
    kept = simhash_variants.keep_one(docs)
    assert kept.columns == docs.columns and simhash_variants.keep_one(empty).count() == 0 and simhash_variants.near_duplicates(empty).count() == 0
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter({c for c in comps if c is not None})


@pytest.mark.parametrize("block", [8, 1024])
def test_simhash_links_of_a_dense_group(spark, block):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in center for _ in range(60)]).astype(np.uint64)
    root = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            root[root == root[i]] = root[j]
    signed = fps.view(np.int64).tolist()
    found = simhash_variants.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found.collect())
    got = {r.node: r.root for r in components.stars(found).collect()}
    classes, want = {}, {}
    for x, r in zip(signed, root):
        classes.setdefault(got.get(x, x), set()).add(x)
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 100)], "a long, b long")
    assert {(r.node, r.root) for r in components.stars(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(100, 99)}


