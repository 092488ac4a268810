"""Fragments of text between ASCII white space, and their pre-tokens.

The vocabulary drops white space and no token holds any, so a text is the sequence
of its white-space-delimited fragments, each of which is encoded by itself: normal
forms, lower-casing and the splitting pattern never look across white space. Prose
repeats its fragments, so each worker encodes a distinct fragment once and keeps the
answer in a cache of bounded size; a fragment that was dropped is encoded again.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

from .common import LOWER

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer

#: Answers that one generation of a worker's cache holds, and the longest fragment it keeps.
CACHED, KEPT_LENGTH = 50_000, 256
#: Letters for which lower-casing and normal form are the same wherever they stand: ASCII and precomposed Latin-1.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_symbols() -> dict[int, str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SYMBOLS = _byte_symbols()


class Vocabulary:
    """A BPE with word ends from a tokenizers file: symbols, ranks, special strings and the library's own normaliser and splitter."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError(f"{path}: not a plain BPE with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self._own = Tokenizer.from_file(path)
        # ids of each byte's symbol, inside a pre-token and at its end
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for b, c in _SYMBOLS.items():
            self.inner[b], self.last[b] = self.ids[c], self.ids[c + self.end]
        self._marks = [t for t in self.special if t]

    def pieces(self, fragment: str) -> list[str | int]:
        """The fragment's pre-tokens as strings of byte symbols, and the ids of special strings in it."""
        if _PLAIN.fullmatch(fragment) and "<|" not in fragment:
            found = _SPLIT.findall(fragment.lower())
            return found if fragment.isascii() else [x if x.isascii() else x.encode().decode("latin-1").translate(_SYMBOLS) for x in found]
        out: list[str | int] = []
        for part in self._apart(fragment):
            if isinstance(part, int):
                out.append(part)
            elif part:
                text = self._own.normalizer.normalize_str(part)
                out += [x for x, _ in self._own.pre_tokenizer.pre_tokenize_str(text) if x]
        return out

    def _apart(self, text: str) -> Iterable[str | int]:
        while True:
            found = min(((k, -len(m), m) for m in self._marks if (k := text.find(m)) >= 0), default=None)
            if found is None:
                yield text
                return
            yield text[: found[0]]
            yield self.special[found[2]]
            text = text[found[0] + len(found[2]) :]


class Cache(dict):
    """Answers by key in two generations: when one is full the older goes. answer(list of new keys) gives what is missing."""

    def __init__(self, answer: Callable[[list], list], size: int = CACHED) -> None:
        super().__init__()
        self.answer, self.limit, self.old = answer, size, {}

    def learn(self, keys: Iterable) -> dict:
        """A dict with the answers for all the keys: itself, or one made for this call where some are long."""
        new = {k for k in keys if k not in self}
        if not new:
            return self
        had = {k: self.old[k] for k in new if k in self.old}
        new = [k for k in new if k not in had]
        fresh = dict(zip(new, self.answer(new), strict=True)) if new else {}
        fresh |= had
        if len(self) + len(fresh) > self.limit:
            here = _Both(fresh, dict(self))
            self.old = here.kept
            self.clear()
            self.update((k, v) for k, v in fresh.items() if len(k) <= KEPT_LENGTH)
            return here
        long = {k: fresh.pop(k) for k in [k for k in fresh if len(k) > KEPT_LENGTH]}
        self.update(fresh)
        return _Both(long, self) if long else self


class _Both(dict):
    def __init__(self, more: dict, kept: dict) -> None:
        super().__init__(more)
        self.kept = kept

    def __missing__(self, key: object) -> object:
        return self.kept[key]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes of text that are scanned together: enough for most pre-tokens to repeat, with arrays of a bounded size.
SCAN_BYTES = 4 << 20
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, _ODD, np.uint8)
    out[33:127] = _OTHER
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    out[[32, *range(9, 14)]] = _SPACE
    return out


_KIND = _kinds()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of lengths[0] places, then those of the next range, and so on."""
    end = np.cumsum(lengths)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(starts - (end - lengths), lengths)


class Units:
    """The pre-tokens of a slice of texts, found on its bytes at once.

    A unit is a pre-token of letters that lower-case by themselves (ASCII and Latin-1),
    a digit, or a run of other ASCII marks. A fragment with anything else, with an
    apostrophe or with the start of a special string is one unit by itself, left to the
    library's own normaliser and splitter.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        n = len(raw)
        self.raw = raw
        low, kind = LOWER[raw], _KIND[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        after = raw[lead + 1] if len(lead) else np.zeros(0, np.uint8)
        sound = (after != 0x97) & (after != 0xB7)
        kind[lead[sound]] = kind[lead[sound] + 1] = _LETTER
        capital = lead[sound & (after < 0x9F)] + 1
        low[capital] += 0x20
        self.low = low
        filled = off[:-1] < off[1:]
        first = np.zeros(n + 1, bool)
        first[off[:-1][filled]] = first[n] = True
        word = kind != _SPACE
        begin = word.copy()
        begin[1:] &= (kind[:-1] == _SPACE) | first[1:n]
        cut = word.copy()
        cut[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | first[1:n]
        bad = (kind == _ODD) | (raw == 39)
        bad[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
        frag = np.flatnonzero(begin)
        odd = np.add.reduceat(bad, frag, dtype=np.int32) > 0 if len(frag) else np.zeros(0, bool)
        inside = np.zeros(n + 1, np.int8)
        inside[frag[odd]] += 1
        nxt = np.r_[frag[1:], n]
        inside[nxt[odd]] -= 1
        inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool) if odd.any() else np.zeros(n, bool)
        cut &= ~inside | begin
        stop = word.copy()
        stop[:-1] &= cut[1:] | ~word[1:]
        self.start = np.flatnonzero(cut)
        self.end = np.flatnonzero(stop) + 1
        self.odd = inside[self.start] if len(self.start) else np.zeros(0, bool)
        self.first = np.searchsorted(self.start, off)  # of text i: units first[i] to first[i + 1]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units that stand for all equal ones, the place among them of each unit that is not odd, those units)."""
        plain = np.flatnonzero(~self.odd)
        size = self.end[plain] - self.start[plain]
        padded = np.concatenate([self.low, np.zeros(16, np.uint8)])
        words = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded.data, strides=(1,))
        mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        stands, place = [], np.zeros(len(plain), np.int64)
        short = np.flatnonzero(size <= 8)
        key = words[self.start[plain[short]]] & mask[size[short]]
        order = np.argsort(key)
        fresh = np.r_[True, key[order][1:] != key[order][:-1]][: len(order)]
        one = order[fresh]
        stands.append(plain[short[one]])
        place[short[order]] = np.cumsum(fresh) - 1
        middle = np.flatnonzero((size > 8) & (size <= 16))
        a, b = words[self.start[plain[middle]]], words[self.start[plain[middle]] + 8] & mask[size[middle] - 8]
        order = np.lexsort((b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])][: len(order)]
        place[middle[order]] = np.cumsum(new) - 1 + len(one)
        stands.append(plain[middle[order[new]]])
        long = np.flatnonzero(size > 16)
        place[long] = np.arange(len(long)) + len(one) + int(new.sum())
        stands.append(plain[long])
        return np.concatenate(stands), place, plain


class Encoded:
    """The ids of every unit, as ranges of one pool."""

    def __init__(self, units: Units, v: Vocabulary, merge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], odd: Callable[[list[bytes]], list[list[int]]]) -> None:
        """merge(bytes, starts) -> (ids, sequence numbers in order) of distinct pre-tokens; odd(fragments) -> their ids."""
        stands, place, plain = units.distinct()
        size = units.end[stands] - units.start[stands]
        starts = np.cumsum(np.r_[0, size[:-1]]) if len(size) else np.zeros(0, np.int64)
        ids, seq = merge(units.low[ragged(units.start[stands], size)], starts)
        count = np.bincount(seq, minlength=len(stands)) if len(stands) else np.zeros(0, np.int64)
        first = np.cumsum(np.r_[0, count[:-1]]) if len(stands) else np.zeros(0, np.int64)
        self.count, self.at = np.zeros(len(units.start), np.int64), np.zeros(len(units.start), np.int64)
        self.count[plain], self.at[plain] = count[place], first[place]
        strange = np.flatnonzero(units.odd)
        if len(strange):
            data = units.raw.tobytes()
            found = odd([data[a:b] for a, b in zip(units.start[strange].tolist(), units.end[strange].tolist(), strict=True)])
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.count[strange], self.at[strange] = n, len(ids) + np.cumsum(np.r_[0, n[:-1]])
            ids = np.concatenate([ids, np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))])
        self.pool = ids
        total = np.cumsum(np.r_[0, self.count])
        self.per_text = np.diff(total[units.first])

    def ids(self) -> np.ndarray:
        """The ids of all texts, one after another; per_text has how many each has."""
        return self.pool[ragged(self.at, self.count)]
