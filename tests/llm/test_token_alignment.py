"""Cross-tokenizer alignment against the two libraries on whole texts and a plain count of pairs."""

import hashlib
import random
from collections import Counter

import pytest

from docketlens.llm import token_alignment
from docketlens.llm.queries import vocabulary
from docketlens.llm.units import byte_of_char, bytes_of_token

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def aligned(text, tok, pieces):
    if not text:
        return None
    a, b, table = tok.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text), byte_of_char()
    part_a = [bytes_of_token(tok.id_to_token(i), table) for i in a]
    part_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(part_a) == b"".join(part_b) == (" " + text).encode():
        return None
    ends = [[len(b"".join(p[:i + 1])) for i in range(len(p))] for p in (part_a, part_b)]
    groups, links, i, j = [], [], 0, 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(c) + 1, ends[1].index(c) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return len(a), len(b), ";".join(groups), links


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(A))
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))


@pytest.mark.parametrize("links", [60, token_alignment.BLOCK_LINKS])
def test_equals_the_libraries(spark, libraries, links):
    rng = random.Random(2)
    texts = [None, "", " ", "  ", "\n", "a", "<|endoftext|> <s> x", "a▁b", "a\r\nb);\r\n", "\r", "été 中文 😀 " * 20, "x" * 300, " " * 40 + "q", "tab\there\x00 z",
             "foo  bar   baz\n\n  qux ", "ﬁ Ａ　b\xa0c ", "the cat " * 700]
    pools = ["abcdeilnorst'' \n\n  .,!?12éßñİΣ\x1c\x1f\x85\xa0 　​᠎中文😀", "ab ", "the of and ", "\r\n a;)}", "  \t\n\x0b\x0cx"]
    texts += ["".join(rng.choices(rng.choice(pools), k=rng.choice([1, 5, 40, 100]))) for _ in range(120)] + ["the cat sat on the mat. the dog"] * 40
    found = [aligned(t, *libraries) for t in texts]
    count = Counter(pair for f in found if f for pair in f[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    want = [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[3]), len(f[3]), sum(count[p] == top[p[1]] for p in f[3]), sum(count[p] for p in f[3]),
                                                      hashlib.sha256(f[2].encode()).hexdigest()) for f in found]
    df = spark.createDataFrame([(i, t, "mine", "z", "t") for i, t in enumerate(texts)] + [(None, None, None, None, None)], "doc_id long, text string, n_a string, `a.b` string, _there string").repartition(3)
    out = token_alignment.align(df, vocabulary(A), vocabulary(B), groups=True, block_links=links)
    assert [c for c in out.columns if c not in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")] == ["doc_id", "text", "a.b", "_there"]
    rows = {r.doc_id: r for r in out.collect()}
    assert [tuple(rows[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for i in range(len(texts))] == want
    assert [rows[i].groups for i in range(len(texts))] == ["" if f is None else f[2] for f in found]
    assert len(rows) == len(texts) + 1 and rows[None].n_a == 0 and rows[0]["a.b"] == "z" and rows[0]["_there"] == "t"


def test_pair_counts(spark, libraries):
    texts = ["the cat sat. the the"] * 30 + ["a dog, the end"] * 3
    found = [aligned(t, *libraries)[3] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    index = token_alignment.build_index(df, vocabulary(A), vocabulary(B), "text", ["doc_id"], False).filter("pair IS NOT NULL")
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in token_alignment.pair_counts(index, libraries[1].vocab_size()).collect()}
    links, docs = Counter(p for f in found for p in f), Counter(p for f in found for p in set(f))
    assert got == {p: (docs[p], n) for p, n in links.items()}
    assert token_alignment.align(df.limit(0), vocabulary(A), vocabulary(B)).count() == 0
