"""Exact encoding by units that never share a token, each distinct unit once per worker.

The two cuts used here:

* ``bare``: units are runs without white space; for vocabularies whose pre-tokenizer drops white space.
* ``led``: units are a run of white space with the run of other characters behind it; for byte-level
  vocabularies whose pattern lets a space lead a word. A token never holds white space behind a character.

The tokenizers library sets the result. Its merge loop is the cost of these operators, so plain Latin text goes
through tiktoken with ranks that are read from the same vocabulary file: the ranks are the merge order, so both
give the same ids. Anything else (other scripts, control characters, apostrophes inside words, special tokens,
white-space runs that its pattern cannot take) goes through the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np

# The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
CUTS = {"bare": re.compile(f"[^{WHITE}]+"), "led": re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")}
# str.split() and \s also cut at these four, which are not White_Space.
ODD = re.compile("[\x1c-\x1f]")
PLAIN = {"bare": str.split, "led": re.compile(r"\s*\S+|\s+").findall}
MAX_CACHED = 300_000
# Units handed to the library at once: its results are many times larger than their ids.
BATCH = 2048
# Units longer than this are encoded but not kept.
MAX_KEPT_CHARS = 256
# Texts of these characters only are split and normalised alike by both libraries, whatever their Unicode version.
NOT_LATIN = re.compile("[^\t-\r -~\xa0-ɏ‐-‧€]")
LATIN_WORD = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
WORD_END, MARK = "</w>", "\x01"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[tuple[str, str], "Units"] = {}


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    chars = {chr(b): b for b in own}
    return chars | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


def bytes_of_token(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)


class _WholeTexts:
    """Byte-level vocabularies: plain texts are encoded whole."""

    def __init__(self, spec: dict):
        import tiktoken

        table = byte_of_char()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes_of_token(t, table): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.coder = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes | None:
        if NOT_LATIN.search(text) or any(s in text for s in self.special):
            return None
        try:
            return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # a white-space run beyond what the pattern can step back over
            return None


class _MarkedWords:
    """Vocabularies with word ends: words with a mark behind each, in one call; the mark stands for the word end."""

    def __init__(self, spec: dict):
        import tiktoken

        table = byte_of_char()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            if t not in special:
                ranks[bytes_of_token(t[:-len(WORD_END)], table) + MARK.encode() if t.endswith(WORD_END) else bytes_of_token(t, table)] = i
        self.coder = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        self.last[[i for b, i in ranks.items() if b.endswith(MARK.encode())]] = True

    def encode(self, parts: list[tuple[str, str]]) -> list[bytes]:
        """The ids of each unit, given as letters and punctuation behind them."""
        text = MARK.join([f"{a.lower()}{MARK}{b}" if b else a.lower() for a, b in parts]) + MARK
        ids = self.coder.encode_to_numpy(text, disallowed_special=())
        ends = np.flatnonzero(self.last[ids]) + 1
        ends = ends[np.cumsum([2 if b else 1 for _, b in parts]) - 1] * 4
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _fast(path: str) -> _WholeTexts | _MarkedWords | None:
    """The tiktoken form of a vocabulary file, if it is one of the two kinds whose rules are known here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, normal = spec["model"], spec["pre_tokenizer"], spec["normalizer"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        return None
    merged = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if [model["vocab"].get(t) for t in merged] != list(range(len(model["vocab"]) - len(merged), len(model["vocab"]))):
        merged = [t for t in merged if t not in {s["content"] for s in spec["added_tokens"]}]
        first = model["vocab"].get(merged[0])
        if [model["vocab"].get(t) for t in merged] != list(range(first, first + len(merged))):
            return None
    if normal is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not model["end_of_word_suffix"]:
        return _WholeTexts(spec)
    steps = [n.get("type") for n in (normal or {}).get("normalizers", [])]
    if model["end_of_word_suffix"] == WORD_END and steps == ["NFC", "Replace", "Lowercase"]:
        return _MarkedWords(spec)
    return None


class Units:
    """A loaded vocabulary with its cache; one per worker process, path and cut."""

    def __init__(self, path: str, cut: str, max_cached: int = MAX_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut, self.max_cached = cut, max_cached
        self.ids: dict[str, bytes] = {}
        fast = _fast(path)
        self.whole = fast if cut == "led" and isinstance(fast, _WholeTexts) else None
        self.marked = fast if cut == "bare" and isinstance(fast, _MarkedWords) else None

    @classmethod
    def of(cls, path: str, cut: str, max_cached: int = MAX_CACHED) -> "Units":
        """``max_cached`` units are kept, at about 200 bytes each; of a full cache the older half goes."""
        if (path, cut) not in _loaded:
            _loaded[path, cut] = cls(path, cut, max_cached)
        _loaded[path, cut].max_cached = max_cached
        return _loaded[path, cut]

    def split(self, text: str) -> list[str]:
        return (CUTS[self.cut].findall if ODD.search(text) else PLAIN[self.cut])(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self.whole is None:
            return self._by_units(texts)
        out = [self.whole.encode(t) for t in texts]
        rest = [i for i, o in enumerate(out) if o is None]
        for i, o in zip(rest, self._by_units([texts[i] for i in rest])):
            out[i] = o
        return out

    def _by_units(self, texts: list[str]) -> list[bytes]:
        units = [self.split(t) for t in texts]
        new = set().union(*units).difference(self.ids)
        if len(self.ids) + len(new) > self.max_cached:
            for u in list(islice(self.ids, len(self.ids) // 2 + 1)):
                del self.ids[u]
            new = set().union(*units).difference(self.ids)
        self._learn(list(new))
        get = self.ids.__getitem__
        out = [b"".join(map(get, u)) for u in units]
        for u in new:
            if len(u) > MAX_KEPT_CHARS:
                del self.ids[u]
        return out

    def _learn(self, new: list[str]) -> None:
        if self.marked is not None:
            plain = [(u, m.groups()) for u, m in zip(new, map(LATIN_WORD, new)) if m]
            for at in range(0, len(plain), BATCH):
                some = plain[at:at + BATCH]
                self.ids.update(zip([u for u, _ in some], self.marked.encode([p for _, p in some])))
            new = [u for u in new if u not in self.ids]
        for at in range(0, len(new), BATCH):
            some = new[at:at + BATCH]
            for u, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.ids[u] = array("I", e.ids).tobytes()

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids and (start, end) code points of one text, encoded whole."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.int64), np.array(e.offsets, np.int64).reshape(-1, 2)

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)
