"""Token ids by the `tokenizers` library, exact and fast: each distinct piece is encoded once.

`encode` of a whole text equals the ids of its words in order whenever the tokenizer cuts at
white space and drops it, as the word file does. Texts of plain Latin letters are cut further,
where the file's own pattern cuts them, by whole arrays; any other text is cut at ASCII white
space only, and the library does the rest. What was learnt is held by the worker process.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np

from .hashing import Known, range_hashes

#: Characters whose class, case and composition are beyond doubt, without the apostrophe that starts an
#: English ending; a text with any other goes the slower way.
ODD = re.compile(r"[^\t-\r -&(-~À-ÖØ-öø-ÿ]|<\|")
BLANK = re.compile(r"[\t-\r ]")
WORDS = re.compile(r"[^\t-\r ]+")
#: The file's own pattern.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(9, 14), 32]] = _SPACE
_CLASS[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_CLASS[48:58] = _DIGIT


#: Characters that go through the arrays at once.
PART = 1 << 20


def _parts(text: str):
    """The text, cut at white space into parts of about PART characters."""
    at = 0
    while len(text) - at > PART:
        space = next((m.start() for m in BLANK.finditer(text, at + PART)), len(text))
        yield text[at:space]
        at = space
    if at < len(text) or not text:
        yield text[at:]


class WordEncoder:
    """`most` bounds the pieces held in memory; beyond it the memory starts anew."""

    def __init__(self, file: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(file), most
        with open(file, encoding="utf-8") as f:
            pre = json.load(f)["pre_tokenizer"]
        first = (pre.get("pretokenizers") or [pre])[0]
        if not (first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") == SPLIT):
            raise ValueError("this encoder needs a tokenizer file that cuts and drops white space")
        self._forget()

    def _forget(self) -> None:
        self.known, self.words = Known(), {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bounds = np.zeros(1 << 16, np.int64)  # of each row in the pool

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (and `end` after each text's), and where each text's begin (one more bound at the end). Null is empty."""
        ids, lengths, some, owners, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            nonlocal some, owners, size
            flat, bounds = self._encode(some)
            ids.append(flat)
            np.add.at(lengths, owners, np.diff(bounds))
            some, owners, size = [], [], 0

        for k, text in enumerate(texts):
            for part in _parts(text or ""):
                if some and size + len(part) > PART:
                    flush()
                some.append(part)
                owners.append(k)
                size += len(part)
        flush()
        flat, bounds = np.concatenate(ids), np.concatenate([[0], np.cumsum(lengths)])
        if end is None:
            return flat, bounds
        closed = bounds + np.arange(len(bounds))
        out = np.full(closed[-1], end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[closed[1:] - 1] = False
        out[inside] = flat
        return out, closed

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        slow = [k for k, t in enumerate(texts) if ODD.search(t)]
        if self.known.size + len(self.words) > self.most:
            self._forget()
        rest = set(slow)
        ids, bounds = self._plain(["" if k in rest else t for k, t in enumerate(texts)])
        if not slow:
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k, own in zip(slow, self._slow([texts[k] for k in slow]), strict=True):
            parts[k] = own
        lengths = np.array([len(x) for x in parts], np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(texts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        joined = "\n".join(texts).lower()
        data = np.frombuffer(joined.encode("latin-1"), np.uint8)
        kind = _CLASS[data]
        new = np.empty(len(data) + 1, bool)
        new[0] = new[-1] = True
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cuts = np.flatnonzero(new)
        solid = kind[cuts[:-1]] != _SPACE
        starts, ends = cuts[:-1][solid], cuts[1:][solid]
        keys = range_hashes(data, starts, ends)
        rows = self.known.find(keys)
        gaps = np.flatnonzero(rows < 0)
        if len(gaps):
            fresh, first = np.unique(keys[gaps], return_index=True)
            at = gaps[first]
            learnt = self._library([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self.known.add(fresh, self._keep(*learnt))
            rows[gaps] = self.known.find(keys[gaps])
        begin, length = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        done = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(begin - done[:-1], length) + np.arange(done[-1])]
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        return ids, done[np.searchsorted(starts, edges)]

    def _slow(self, texts: list[str]) -> list[np.ndarray]:
        cut = [WORDS.findall(t) for t in texts]
        fresh = list({w for words in cut for w in words} - self.words.keys())
        flat, lengths = self._library(fresh)
        self.words.update(zip(fresh, np.split(flat, np.cumsum(lengths)[:-1]) if fresh else [], strict=True))
        none = np.zeros(0, np.uint32)
        return [np.concatenate([self.words[w] for w in words]) if words else none for words in cut]

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each word's. Many words go to the library as one text and come apart at the offsets."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            joined = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.array(joined.offsets, np.int64).reshape(-1, 2)[:, 1]
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            ids.append(np.array(joined.ids, np.uint32))
            lengths.append(np.diff(np.searchsorted(ends, starts, "right")))
        return np.concatenate(ids), np.concatenate(lengths)

    def _keep(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Appends to the pool; the new rows' numbers."""
        n = self.known.size
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(lengths) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.bounds[n + 1 : n + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used += len(flat)
        return np.arange(n, n + len(lengths), dtype=np.int32)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """One encoder for each file and worker process; what it has learnt serves later tasks too."""
    if file not in _ENCODERS:
        _ENCODERS[file] = WordEncoder(file)
    return _ENCODERS[file]


def word_file() -> str:
    """The file named by the contract; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
