"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever makes a vocabulary token, so two neighbouring symbols whose pair
occurs inside no token are never joined: such a pair is a certain cut. The table of
those pairs comes from the vocabulary once; every pre-token is cut by it, the parts
are encoded by themselves, and the ids concatenated. White space is such a cut too,
for no token holds any, so a text is encoded fragment by fragment. The parts are
short whatever the text: a run of 100,000 letters without a space falls into parts
that the vocabulary could join.

The word end belongs to the last part of a pre-token only; the table holds pairs
with the word end apart from those without. This vocabulary names no decoder, so
decoding joins the tokens by single spaces, as the library does.

Nulls are empty texts, which have no ids and decode to nothing. The work is map-only
and rows that repeat are answered alike. Columns of the input that are named as those
added, in any case, stay, and the added ones get an underscore more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, ship, text_slices, tidy
from .pretokens import _SYMBOLS, SCAN_BYTES, Encoded, Units, ragged, word_bpe
from .tokencount import Counter


class Encoder(Counter):
    """Ids of texts by cutting pre-tokens at forced boundaries and merging the parts by themselves."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        v = self.v
        byte = {c: b for b, c in _SYMBOLS.items()}
        #: Whether two bytes occur as neighbours inside some token, before its end and as its last two.
        self.joined, self.closing = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        for token in v.ids:
            closed = bool(v.end) and token.endswith(v.end)
            body = [byte[c] for c in (token[: -len(v.end)] if closed else token) if c in byte]
            for k in range(len(body) - 1):
                (self.closing if closed and k == len(body) - 2 else self.joined)[body[k], body[k + 1]] = True
        n = max(v.tokens) + 1
        self.digits = _Table([b"%d " % k for k in range(n)])
        self.words = _Table([v.tokens.get(k, "").encode() + b" " for k in range(n)])

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        last = np.zeros(n, bool)
        last[np.r_[starts[1:], n][: len(starts)] - 1] = True
        flat = np.where(last, self.v.last[data], self.v.inner[data])
        cut = np.zeros(n, bool)
        cut[1:] = ~np.where(last[1:], self.closing[data[:-1], data[1:]], self.joined[data[:-1], data[1:]])
        cut[starts] = True
        begin = np.flatnonzero(cut)
        ids, part = self.merger.merge(flat, begin)
        # parts keep their order, so their ids concatenate to those of their pre-token
        return ids, np.searchsorted(starts, begin, side="right")[part] - 1 if n else part

    def odd_ids(self, fragments: list[bytes]) -> list[list[int]]:
        split = [self.v.pieces(f.decode("utf-8")) for f in fragments]
        byte = {c: b for b, c in _SYMBOLS.items()}
        todo = list({p for x in split for p in x if not isinstance(p, int)})
        data = [bytes(byte[c] for c in p) for p in todo]
        size = np.fromiter(map(len, data), np.int64, len(data))
        ids, seq = self.merge(np.frombuffer(b"".join(data), np.uint8), np.cumsum(np.r_[0, size[:-1]])[: len(data)])
        edge, ids = np.searchsorted(seq, np.arange(len(todo) + 1)).tolist(), ids.tolist()
        known = {p: ids[x:y] for p, x, y in zip(todo, edge, edge[1:], strict=False)}
        return [[i for p in x for i in ((p,) if isinstance(p, int) else known[p])] for x in split]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        e = Encoded(Units(raw, off), self.v, self.merge, self.odd)
        return e.ids(), e.per_text

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.v.tokens[i] for i in ids)


class _Table:
    """Byte strings by number, written one after another for an array of numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(np.r_[0, self.size[:-1]])

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of the ids, and the place after each."""
        size = self.size[ids]
        return self.data[ragged(self.start[ids], size)].tobytes(), np.cumsum(size)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Ids that are written out at once, so the texts made of them have a bounded size.
WRITTEN = 1 << 18


def _digests(table: _Table, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
    """SHA-256 of each text's strings joined by spaces."""
    out, begin = [], 0
    edge = np.r_[0, np.cumsum(per_text)]
    while begin < len(per_text):
        end = max(begin + 1, int(np.searchsorted(edge, edge[begin] + WRITTEN, side="right")) - 1)
        end = min(end, len(per_text))
        if edge[end] - edge[begin] > WRITTEN:  # one long text: in steps, less the last space
            h, stop = hashlib.sha256(), edge[end]
            for s in range(edge[begin], stop, WRITTEN):
                part = table.write(ids[s : min(s + WRITTEN, stop)])[0]
                h.update(part if s + WRITTEN < stop else part[:-1])
            out.append(h.hexdigest())
        else:
            data, after = table.write(ids[edge[begin] : edge[end]])
            at = np.r_[0, after][edge[begin : end + 1] - edge[begin]].tolist()
            view = memoryview(data)
            out += [hashlib.sha256(view[x : max(x, y - 1)]).hexdigest() for x, y in zip(at, at[1:], strict=False)]
        begin = end
    return out


def encode(documents: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """documents with the ids of each whole text in an array column."""
    schema = plus(documents, **{out: "array<int>"})
    ship(documents.sparkSession)
    path = path or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for b in batches:
            found = [e.encode(raw, o) for _, _, raw, o in text_slices(b[text], SCAN_BYTES)]
            ids = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            off = np.r_[0, np.cumsum(np.concatenate([n for _, n in found]))] if found else np.zeros(1, np.int64)
            col = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=schema.names)

    return documents.mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with the text of an array column of ids; a null array decodes to an empty text."""
    schema = plus(rows, **{out: "string"})
    ship(rows.sparkSession)
    path = path or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for b in batches:
            texts = [e.decode(x or []) for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)


def round_trip(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """documents, without the text, with n_tokens and digests of ids and decoded text; both are made and
    digested in one pass, so neither is ever moved or stored."""
    ship(documents.sparkSession)
    path = path or word_bpe()
    keep = [c for c in documents.columns if c != text]
    schema = plus(documents.select(*keep), n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for b in batches:
            n, ids, back = [], [], []
            for _, _, raw, off in text_slices(b[text], SCAN_BYTES):
                found, per_text = e.encode(raw, off)
                n.append(per_text)
                ids += _digests(e.digits, found, per_text)
                back += _digests(e.words, found, per_text)
            cols = [b[c] for c in keep] + [pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return documents.mapInArrow(tidy(run), schema)


def digest(documents: DataFrame) -> DataFrame:
    """The contract of op5."""
    return round_trip(documents.select("doc_id", "text"))
