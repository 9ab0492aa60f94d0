"""run() of the pipeline against a plain program over the same documents."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from docketlens.llm import quality_rules, secret_index
from docketlens.llm.queries import vocabulary
from tests.llm.test_llm import WORD, brute_components

SF = "/root/testdata/sf0.001"
RULES = quality_rules.Rules()


def line_fails(line):
    w = WORD.findall(line)
    seps = sum(x in "|»›•·" for x in w if len(x) == 1)
    if not w:
        return False
    if seps >= RULES.min_separators and seps * RULES.words_per_separator >= len(w):
        return True
    if len(w) <= RULES.max_boilerplate_words and any(p in line.lower() for p in quality_rules.BOILERPLATE):
        return True
    if sum(bool(re.search(r"[#*$%&|<>]|!!", x)) for x in w) * 100 > len(w) * RULES.max_noisy_percent:
        return True
    return len(w) < RULES.min_words_without_end and not re.search(r"[.!?…。！？:;,)\]\"'”’»\-]\s*$", line)


def cleaned(text):
    w = WORD.findall(text)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(wins)
    repeats = len({j for i, x in enumerate(wins) if seen[x] > 1 for j in (i, i + 1, i + 2)})
    if len(w) < 50 or 100 * repeats > 50 * len(w):
        return None
    good = [x for x in text.split("\n") if not line_fails(x)]
    lost = sum(map(len, w)) - sum(map(len, WORD.findall("\n".join(good))))
    return None if lost * 100 > sum(map(len, w)) * RULES.max_lost_percent else "\n".join(good)


def redacted(text):
    spans = []
    for o, r in enumerate(secret_index.RULES):
        spans += [(m.start(), o, m.end(), r.kind) for m in re.finditer(r.pattern, text, r.flags) if len(m.group(r.group)) >= r.min_chars]
    out, at = "", 0
    for s, _, e, kind in sorted(spans):
        if s >= at:
            out += text[at:s] + f"[{kind}]"
        at = max(at, e)
    return out + text[at:]


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    amount, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        level = (amount - sum(capped.values())) / sum(weight[n] for n in free)
        over = {n: 2 * sizes[n] for n in free if weight[n] * level > 2 * sizes[n]}
        if not over:
            return {n: capped.get(n, weight[n] * level) for n in names}
        capped.update(over)


def mixed(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sizes = {s: sum(len(WORD.findall(r[1])) for r in v) for s, v in by.items()}
    goal, out = targets(sizes), []
    for s, v in by.items():
        left = round(goal[s])
        for _ in range(2):
            for r in sorted(v, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
                n = len(WORD.findall(r[1]))
                take = min(n, left)
                left -= take
                if take:
                    text = r[1] if take == n else r[1][:list(WORD.finditer(r[1]))[take - 1].end()]
                    out.append((r[0], text, r[2], s))
    return out


@pytest.fixture(scope="module")
def expected(spark):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, cleaned(r.text or ""), r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if r[1] is not None]
    _, comps = brute_components([(r[0], r[1]) for r in rows])
    rows = [(r[0], redacted(r[1]), *r[2:]) for r, c in zip(rows, comps) if r[0] == c]
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = Counter()
    for d, text, _, source in mixed(rows):
        ids = tok.encode(text, add_special_tokens=False).ids
        out[d, source, len(text), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


def test_run_equals_plain_program(spark, expected):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == expected


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)
