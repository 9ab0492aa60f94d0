"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From its parse tree comes a Boolean query: an OR of ANDs of trigrams
that every match must contain, in lower-cased ASCII. The documents of a partition are indexed in segments:
postings from each needed trigram to the documents that hold it. A rule's query is answered by intersecting and
uniting postings, and only those candidates are searched with the expression itself. A rule whose expression
forces no trigram reads every document. The index lives beside the texts it covers, so no text is shuffled,
and one pass over the table answers all rules.

Defined results:

* NULL and empty texts have no spans. Every input row is returned once, repeated rows with equal spans.
* Very long texts are indexed in pieces that overlap by two bytes; expressions run over the whole text.
* Positions are code points, the end exclusive. Spans are sorted by start, then by the order of the rules.
* Redaction unites overlapping spans and names the first rule; the result holds no character of any span.
* Added columns replace input columns of the same name; all others are passed through unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from docketlens.llm.words import apart

try:
    from re import _constants as sre, _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

MAX_STRINGS = 256
MAX_CLASS = 10
SEGMENT_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    min_chars: int = 1


# The first three are given, the rest are public token formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", min_chars=20),
    Rule("hex", "[0-9a-f]+", min_chars=24),
)
RULES = BASE + (
    # Header lines and base64 lines, parted by white space or written-out line breaks, to the END line or as far as they go.
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
                r"(?:(?:\s+[A-Za-z-]+:\x20[^\r\n]*)*(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{16,})*(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{1,15})?(?:\s|\\[nr])*-----END (?:[A-Z]+ )*PRIVATE KEY-----"
                r"|(?:\s+[A-Za-z-]+:\x20[^\r\n]*)*(?:\s+[A-Za-z0-9+/=]{16,}(?![^\s]))*(?:\s+[A-Za-z0-9+/]*={1,2}(?![^\s]))?)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login_url", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@"),
)

Query = frozenset  # of frozensets of trigrams: an OR of ANDs


def _and(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    return _absorb(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= MAX_STRINGS else a


def _absorb(q: Query) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Query | None:
    """Any of these strings occurs; None (no restriction) if one of them holds no trigram."""
    if any(len(s.encode()) < 3 for s in strings):
        return None
    grams = (s.encode().lower() for s in strings)
    return _absorb(frozenset(frozenset(g[i:i + 3] for i in range(len(g) - 2)) for g in grams))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _walk(nodes) -> tuple[set[str] | None, Query | None]:
    """(every string that the sequence can match, or None if they cannot be listed; its query)."""
    whole, part, query = True, {""}, None

    def flush():
        nonlocal part, query
        query, part = _and(query, _of_strings(part)), {""}

    for op, arg in nodes:
        strings, inner = None, None
        if op is sre.LITERAL:
            strings = {chr(arg)}
        elif op is sre.IN:
            strings = _class(arg)
        elif op is sre.AT:
            strings = {""}
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in sides):
                strings = set().union(*(s for s, _ in sides))
            else:
                queries = [_and(_of_strings(s) if s is not None else None, q) for s, q in sides]
                inner = None if None in queries else _absorb(frozenset().union(*queries))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            strings, inner = _walk(body)
            inner = inner if low else None
            if strings is not None and (low, high) == (0, 1):
                strings = strings | {""}
            elif strings is not None and low and len(strings) ** low * len(part) <= MAX_STRINGS:
                repeated = {"".join(x) for x in product(strings, repeat=low)}
                if low == high:
                    strings = repeated
                else:
                    part, strings = {a + b for a in part for b in repeated}, None
            elif (low, high) != (1, 1):
                strings = None
        if strings is not None and len(part) * len(strings) <= MAX_STRINGS:
            part = {a + b for a in part for b in strings}
            continue
        whole = False
        flush()
        query = _and(query, inner)
    if whole:
        return part, None
    flush()
    return None, query


def trigram_query(rule: Rule) -> Query | None:
    """OR of ANDs of lower-cased trigrams that any match must hold; None if none is certain."""
    strings, query = _walk(sre_parser.parse(rule.pattern, rule.flags))
    return _of_strings(strings) if strings is not None else query


def postings(texts: list[bytes], grams: list[bytes]) -> dict[bytes, np.ndarray]:
    """The inverted index of one segment: trigram -> ascending numbers of the texts that hold it."""
    table = np.zeros(1 << 24, np.uint16)
    for i, g in enumerate(grams):
        table[int.from_bytes(g, "big")] = i + 1
    return _postings(texts, grams, table)


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _postings(texts: list[bytes], grams: list[bytes], table: np.ndarray) -> dict[bytes, np.ndarray]:
    found = []
    # Two zero bytes part the texts, so that no trigram of the query spans two of them.
    ends = np.cumsum([len(t) + 2 for t in texts])
    joined = np.frombuffer(b"".join(x for t in texts for x in (t, b"\0\0")), np.uint8)
    for at in range(0, max(len(joined) - 2, 0), SEGMENT_BYTES):
        low = _LOWER[joined[at:at + SEGMENT_BYTES + 2]].astype(np.uint32)
        hits = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        where = np.flatnonzero(hits)
        found.append(np.stack([hits[where].astype(np.int64), np.searchsorted(ends, where + at, "right")]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return {g: pairs[1, pairs[0] == i + 1] for i, g in enumerate(grams)}


def candidates(query: Query, index: dict[bytes, np.ndarray]) -> np.ndarray:
    """Texts that satisfy the query: postings intersected inside a clause, united over clauses."""
    out = np.zeros(0, np.int64)
    for clause in query:
        lists = sorted((index[g] for g in clause), key=len)
        have = lists[0]
        for more in lists[1:]:
            have = np.intersect1d(have, more, assume_unique=True)
        out = np.union1d(out, have)
    return out


def _spans(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.min_chars]


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None,
         redacting: bool = False) -> DataFrame:
    """The columns ``keep`` (all of them by default) with ``spans`` and, if asked for, ``redacted_text``."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "redacted_text")]
    src = docs.select(F.struct(F.lit(True).alias("_row_is_there"), *[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"))
    queries = [trigram_query(r) for r in rules]
    grams = sorted({g for q in queries if q is not None for clause in q for g in clause})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expressions = [re.compile(r.pattern, r.flags) for r in rules]
        table = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(grams):
            table[int.from_bytes(g, "big")] = i + 1
        for b in batches:
            at, sizes = 0, pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SEGMENT_BYTES)))
                yield segment(b.slice(at, n), expressions, table)
                at += n

    def segment(b: pa.RecordBatch, expressions, table) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(1).to_pylist()]
        index = _postings([t.encode() for t in texts], grams, table)
        found: list[list[tuple]] = [[] for _ in texts]
        for order, (rule, q, expression) in enumerate(zip(rules, queries, expressions)):
            for i in range(len(texts)) if q is None else candidates(q, index).tolist():
                found[i] += [(s, order, e) for s, e in _spans(rule, expression, texts[i])]
        spans, clean = [], []
        for t, f in zip(texts, found):
            f.sort()
            spans.append([{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in f])
            clean.append(redacted(t, [(s, e, rules[o].kind) for s, o, e in f]) if redacting else None)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(clean, pa.string())], names=["row", "spans", "redacted_text"])

    schema = StructType([src.schema["row"], *StructType.fromDDL("spans array<struct<kind:string,start:int,end:int>>, redacted_text string")])
    out = src.mapInArrow(run, schema).select("row.*", "spans", "redacted_text").drop("_row_is_there")
    return out if redacting else out.drop("redacted_text")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; NULL texts stay NULL."""
    return apart(docs, ["text", "n_chars"], lambda d: _redact(d, rules))


def _redact(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    out = scan(docs.withColumn("_null", F.col("text").isNull()), rules=rules, redacting=True).withColumn("text", F.when(~F.col("_null"), F.col("redacted_text")))
    if "n_chars" in docs.columns:
        hit = F.size("spans") > 0
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
