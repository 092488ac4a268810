"""Removal of globally repeated passages, by content-defined chunks of lines.

A word ends at white space; a character from U+3000 to U+9FFF (Chinese, Japanese) is a
word by itself. A line ends at a newline, or at a full stop, question or exclamation mark
before a space, so passages inside long paragraphs count too; its content is its words.
A chunk boundary lies before a line whose rolling hash is below that of the line before
it: the choice depends on two neighbouring lines only, so text inserted elsewhere shifts
nothing. Two such chunkings with unrelated hashes are used, which leaves few passages
without a whole chunk inside. A chunk counts if it has two lines and MIN_WORDS words, or
LONE_WORDS words in one line.

Chunks of lines may miss a passage, so runs of words have keys too, whatever the lines:
of each WINDOW neighbouring runs of GRAM words the one with the least hash is a key. The
choice depends on those words only, so two texts that share GRAM + WINDOW - 1 = 51 words
in a row always share a key inside them, also where a passage stands in the middle of a
sentence or has no full stop. Scripts such as Thai that set no spaces between words have
phrases for words, and 51 of those are needed. Keys overlap or touch, as WINDOW <= GRAM.

1. Hashes of all chunks and keys are counted. Those that occur twice set bits in a bitmap
   of fixed size (BITMAP_BITS, so the broadcast is bounded; a full bitmap filters less
   and loses nothing). Hashes with more rows than HOT_ROWS and a HOT_SHARE-th of a task's
   even share are listed with the number of parts they are cut into; there can be at most
   HOT_SHARE of them a task.
2. Chunks and keys that pass the bitmap travel with their bytes to their hash, hot ones to
   a part of it by their document's hash. A key that the next key overlaps brings only
   the words before that one. There they are compared byte by byte with the first, in
   order of doc_id and place (words joined by one space). Every later one is a repeat of
   as many words as both brought. The firsts of the parts of hot hashes meet again, FAN
   parts at a time, until all have met.
3. Repeats that touch are one run of words. What stands around the firsts of the ends of
   runs, CONTEXT words on either side, is fetched from their documents and sent to the
   runs, in as many copies as the runs that ask for it fill parts. They grow over all words
   that equal it byte by byte. A shared stretch that went on for 26 words beyond a run would
   have had a further key, so with that it has the full extent it shares with the first,
   however short its lines.
4. The runs go to their documents, which are cut; a document without any does not travel.
   A word goes with the space after it, a line with its end. Of a run that overlaps its
   first occurrence only the part beyond that goes. If asked to (`whole`), what is left of
   a document goes too where at least such a share of its words repeats documents whose
   length is like its own (SIMILAR): then it is a near copy, and not one that holds a
   passage of a longer text.

The first occurrence of a passage stays, so a document that copies another whole is
left empty, not dropped. A document is its doc_id and text: rows that repeat both are
one document and fare alike. A null text has no lines and stays null; null ids come
first in the order. n_cut counts the lines that lost text. Columns of the input that are
named as those added keep their values under their names, and the added ones get an
underscore more (deduplicate's n_lines and n_cut); other names are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import checkpoint
from .common import _powers, bit_set, bitmap_of, distinct, free_name, joined, marked, mix, ship, span_hashes, text_slices, tidy

MIN_WORDS, LONE_WORDS = 10, 20
GRAM, WINDOW, CONTEXT = 26, 26, 50
#: Least share that the shorter of two documents has of the longer one's words for a near copy, and the share of words that a
#: near copy repeats: with 8 of 9 words in common, two texts of one length have a similarity of 0.8.
SIMILAR, WHOLE = 0.8, 8 / 9
#: Bytes of text worked on at a time; arrays over bytes and words take some 50 times that.
SLICE = 1 << 18
HOT_ROWS, HOT_SHARE, FAN = 256, 16, 32
#: Hashes that a task gathers before it sends them, and buckets a task that they are counted in.
GATHERED, BUCKETS = 1 << 22, 4
_KEY, _CHUNK = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


class Lines:
    """Lines and words of a slice of texts: where they are, and hashes of runs of words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        self.raw, self.off = raw, off
        newline, stop = raw == 10, (raw == 33) | (raw == 46) | (raw == 63)
        stop[:-1] &= raw[1:] == 32
        stop[-1:] = False
        filled = off[:-1] < off[1:]
        stop[off[1:][filled] - 1] = False  # a mark that ends a text ends its line anyway
        ends = np.zeros(len(raw) + 1, bool)
        ends[1:] |= newline
        ends[2:] |= stop[:-1]
        ends[off[1:][filled]] = True
        self.end = np.flatnonzero(ends)
        self.start = np.r_[0, self.end[:-1]] if len(self.end) else self.end
        self.first = np.searchsorted(self.start, off) if len(self.start) else np.zeros(len(off), np.int64)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        begins = ~space
        begins[1:] &= space[:-1] | ends[1:-1]
        lead = np.flatnonzero((raw >= 0xE3) & (raw <= 0xE9))
        begins[lead] = True
        lead = lead[lead + 3 < len(raw)] + 3
        begins[lead] |= ~space[lead]
        self.word_start = np.flatnonzero(begins)
        self.word_end = np.flatnonzero(~space & np.r_[(space | begins)[1:], True]) + 1 if len(raw) else self.word_start
        self.word_first = np.searchsorted(self.word_start, off)
        self.line_word = np.searchsorted(self.word_start, np.r_[self.start, len(raw)])  # the first word of each line

    def hashed(self) -> Lines:
        n = len(self.word_start)
        p, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(span_hashes(self.raw, self.word_start, self.word_end) * p[:n], out=self.sums[1:])
        return self

    def _hash(self, a: np.ndarray, b: np.ndarray, tag: np.ndarray | np.uint64) -> np.ndarray:
        """Hashes of the words from a to b."""
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + tag)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, hash) of the chunks that count, of both chunkings."""
        n = len(self.start)
        if not n:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        line = self._hash(self.line_word[:-1], self.line_word[1:], np.uint64(0))
        edge = np.zeros(n + 1, bool)
        edge[self.first] = True
        found = []
        for seed in (np.uint64(0x51ED270B0A1F39C1), np.uint64(0xB5297A4D2C8E6F3B)):
            r = mix(line ^ seed)
            cut = edge.copy()
            cut[1:-1] |= r[1:] < r[:-1]
            cut[-1] = True
            at = np.flatnonzero(cut)
            a, b = at[:-1], at[1:]
            words = self.line_word[b] - self.line_word[a]
            ok = ((b - a >= 2) & (words >= MIN_WORDS)) | (words >= LONE_WORDS)
            found.append(self.line_word[a[ok]] * (len(self.word_start) + 1) + self.line_word[b[ok]])
        a, b = np.divmod(distinct(np.concatenate(found)), len(self.word_start) + 1)
        return a, b, self._hash(a, b, (b - a).astype(np.uint64) * _CHUNK)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the runs of GRAM words that are the least of some WINDOW neighbouring ones."""
        n = len(self.word_start) - GRAM + 1
        if n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[:n] + _KEY)
        last = np.repeat(self.word_first[1:], np.diff(self.word_first))[:n]
        whole = np.arange(n) + GRAM <= last
        low = _slide(np.where(whole, h, np.uint64(2**64 - 1)), np.minimum)
        low[np.arange(len(low)) + GRAM + WINDOW - 1 > last[: len(low)]] = 0
        ends = np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero(whole & (_slide(np.r_[ends, low, ends], np.maximum) == h))
        return at, h[at]

    def joined(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """For each pair the words from a to b, joined by single spaces."""
        return joined(self.raw, self.word_start, self.word_end, a, b)

    def cut_at(self, word: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The byte at which text is cut before a word: the start of its line if it is the first there, and of a text its start and end."""
        a, z = self.word_first[doc], self.word_first[doc + 1]
        if not len(self.word_start):
            return np.where(word > 0, self.off[doc + 1], self.off[doc])
        w = np.minimum(a + word, len(self.word_start) - 1)
        line = np.searchsorted(self.start, self.word_start[w], side="right") - 1
        at = np.where(self.line_word[line] == w, self.start[line], self.word_start[w])
        return np.where(word <= 0, self.off[doc], np.where(a + word >= z, self.off[doc + 1], at))


def _slide(v: np.ndarray, f: np.ufunc) -> np.ndarray:
    """f over every WINDOW neighbouring values."""
    width = 1
    while 2 * width <= WINDOW:
        v, width = f(v[:-width], v[width:]), 2 * width
    return f(v[: width - WINDOW], v[WINDOW - width :]) if width < WINDOW else v


def _hashes(text: str, buckets: int):
    """The hashes of chunks and keys in packs: of the hashes gathered so far those of a bucket in one row."""
    def packs(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(gathered)
        bucket = _bucket(h, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, h = bucket[order], h[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for s in range(0, len(edge) - 1, 8192):
            e = edge[s : s + 8193]
            packed = pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, pa.py_buffer((8 * (e - e[0])).astype(np.int32)), pa.py_buffer(h[e[0] : e[-1]])])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[e[:-1]]), packed], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for b in batches:
            for _, _, raw, off in text_slices(b[text], SLICE):
                lines = Lines(raw, off).hashed()
                gathered.append(np.r_[lines.chunks()[2], lines.grams()[1]])
                n += len(gathered[-1])
                if n > GATHERED:
                    yield from packs(gathered)
                    gathered, n = [], 0
        if n:
            yield from packs(gathered)

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs sorted by bucket: the hashes that occur twice, with their counts. A bucket is held at a time."""
    def count(packs: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(packs))
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        n = np.diff(edge)
        return pa.RecordBatch.from_arrays([pa.array(h[edge[:-1][n > 1]].view(np.int64)), pa.array(n[n > 1])], names=["h", "count"])

    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b["bucket"].to_numpy()
        data, off = _bytes_of(b["packed"])
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
        for s, e in zip(edge, edge[1:], strict=False):
            if at is not None and bucket[s] != at:
                yield count(held)
                held = []
            at = bucket[s]
            held.append(np.frombuffer(data[off[s] : off[e]].tobytes(), np.uint64))
    if held:
        yield count(held)


#: A chunk or key: its hash and the part of it, its document, first word, words it has and brought, words before the text ends.
_FOUND = "h long, salt int, id {id}, th long, at int, size int, n int, rest int, words binary"
#: A repeat, or the first of a part of a hot hash: its place and the first's, and whether both are in one document.
_MET = "salt int, id {id}, th long, lo int, hi int, rest int, h long, fth long, fat int, skip int, own boolean, alike boolean, first boolean, size int, words binary"


def _parts(hot: tuple[np.ndarray, np.ndarray], key: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The part of its hash that a row goes to."""
    h, parts = hot
    if not len(h):
        return np.zeros(len(key), np.int32)
    k = np.minimum(np.searchsorted(h, key), len(h) - 1)
    return np.where(h[k] == key, (th.view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts[k], 0).astype(np.int32)


def _candidates(bitmap, hot, text: str, doc_id: str):
    """Chunks and keys whose hash is set in the bitmap, with their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b[doc_id], b["th"].to_numpy()
            for row, _, raw, off in text_slices(b[text], SLICE):
                lines = Lines(raw, off).hashed()
                a, e, h = lines.chunks()
                ok = bit_set(bitmap.value, h)
                a, e, h = a[ok], e[ok], h[ok]
                at, key = lines.grams()
                ok = bit_set(bitmap.value, key)
                at, key = at[ok], key[ok]
                # up to the next key, if that begins inside this one
                brought = np.full(len(at), GRAM)
                if len(at):
                    brought[:-1] = np.minimum(GRAM, np.diff(at))
                every = np.r_[a, at], np.r_[e - a, np.full(len(at), GRAM)], np.r_[e - a, brought], np.r_[h, key].view(np.int64)
                for s in range(0, len(every[0]), 8192):
                    first, size, n, hash_ = (c[s : s + 8192] for c in every)
                    doc = np.searchsorted(lines.word_first, first, side="right") - 1
                    t = th[row + doc]
                    cols = [pa.array(hash_), pa.array(_parts(hot.value, hash_, t)), ids.take(pa.array(row + doc)), pa.array(t)]
                    cols += [pa.array(c.astype(np.int32)) for c in (first - lines.word_first[doc], size, n, lines.word_first[doc + 1] - first - n)]
                    yield pa.RecordBatch.from_arrays([*cols, lines.joined(first, first + n)], names=["h", "salt", "id", "th", "at", "size", "n", "rest", "words"])

    return run


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Null-safe equality."""
    return pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8), off.astype(np.int64)


def _begin_alike(data: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the shorter of the byte strings at places a and b begins the longer one."""
    n = np.minimum(off[a + 1] - off[a], off[b + 1] - off[b])
    out = np.ones(len(a), bool)
    some = np.flatnonzero((n > 0) & (a != b))
    for s in range(0, len(some), 4096):
        k = some[s : s + 4096]
        start = np.cumsum(n[k]) - n[k]
        step = np.arange(n[k].sum()) - np.repeat(start, n[k])
        same = data[np.repeat(off[a[k]], n[k]) + step] == data[np.repeat(off[b[k]], n[k]) + step]
        out[k] = np.logical_and.reduceat(same, start)
    return out


def _repeats(spread):
    """From candidates sorted by hash, part and place: the repeats, and the firsts of hot hashes (first set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = spread.value[0] if spread is not None else np.zeros(0, np.int64)
        head = None  # the firsts of the last hash, of which more rows may come
        for b in batches:
            if not b.num_rows:
                continue
            carried = 0
            if head is not None:
                carried = head.num_rows
                b = pa.Table.from_batches([head, b]).combine_chunks().to_batches()[0]
            h, salt, th, at, size, n, rest = (b[c].to_numpy() for c in ("h", "salt", "th", "at", "size", "n", "rest"))
            data, off = _bytes_of(b["words"])
            new = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            bad = np.flatnonzero(~_begin_alike(data, off, np.arange(len(h)), first) | (size != size[first]))
            while len(bad):  # words that differ under one hash: the first of them is a first too
                lead = np.r_[True, first[bad[1:]] != first[bad[:-1]]]
                chosen = bad[np.maximum.accumulate(np.where(lead, np.arange(len(bad)), 0))]
                first[bad] = chosen
                bad = bad[~_begin_alike(data, off, bad, chosen) | (size[bad] != size[chosen])]
            mine = np.arange(len(h))
            own = _same(b["id"], b["id"].take(pa.array(first))) & (th == th[first])
            again = (first != mine) & ~(own & (at == at[first])) & (mine >= carried)
            both = np.minimum(n, n[first])
            total = at + n + rest  # words of the document
            alike = ~own & (np.minimum(total, total[first]) >= SIMILAR * np.maximum(total, total[first]))
            # where words overlap their first occurrence, that stays
            start = np.where(own, np.maximum(at, at[first] + size), at)
            k = np.flatnonzero(again & (start < at + both))
            if len(k):
                yield result(b, k, start[k], at[k] + both[k], rest[k] + n[k] - both[k], th[first[k]], at[first[k]], start[k] - at[k], own[k], alike[k], False)
            k = np.flatnonzero((first == mine) & (mine >= carried) & np.isin(h, hot))
            if len(k):
                yield result(b, k, at[k], at[k] + n[k], rest[k], th[k], at[k], at[k] * 0, own[k], alike[k], True)
            last = mine[(h == h[-1]) & (salt == salt[-1]) & (first == mine)]
            head = b.take(pa.array(last))

    def result(b, k, lo, hi, rest, fth, fat, skip, own, alike, is_first: bool) -> pa.RecordBatch:
        take = pa.array(k)
        words = b["words"].take(take) if is_first else pa.nulls(len(k), pa.binary())
        ints = [pa.array(c.astype(np.int32)) for c in (lo, hi, rest)]
        cols = [b["salt"].take(take), b["id"].take(take), b["th"].take(take), *ints, b["h"].take(take), pa.array(fth), pa.array(fat.astype(np.int32)), pa.array(skip.astype(np.int32)), pa.array(own), pa.array(alike), pa.array(np.full(len(k), is_first)), b["size"].take(take), words]
        return pa.RecordBatch.from_arrays(cols, names=["salt", "id", "th", "lo", "hi", "rest", "h", "fth", "fat", "skip", "own", "alike", "first", "size", "words"])

    return run


def _meet(rows: DataFrame, spread, n: int, most: int) -> DataFrame:
    """The repeats among candidates; most: the parts of the hottest hash. The firsts of its parts meet FAN parts at a time."""
    out = _MET.format(id=rows.schema["id"].dataType.simpleString())
    place = ["h", "salt", "id", "th", "at"]
    found = None
    while True:
        met = checkpoint(rows.repartition(n, "h", "salt").sortWithinPartitions(*place).mapInArrow(tidy(_repeats(spread if most > 1 else None)), out))
        later = met.where("not first").drop("salt", "first", "words")
        found = later if found is None else found.unionByName(later)
        if most <= 1:
            return found
        most = -(-most // FAN)
        rows = met.where("first").select("h", F.floor(F.col("salt") / FAN).cast("int").alias("salt"), "id", "th", F.col("lo").alias("at"), "size", (F.col("hi") - F.col("lo")).alias("n"), "rest", "words")


#: A run, the repeats at its ends (where the firsts are) and whether it may grow there: not where its text begins or ends.
_RUN = "id {id}, th long, lo int, hi int, wall int, into int, alike boolean, low_h long, low_fth long, low_fat int, low_grows boolean, high_h long, high_fth long, high_fat int, high_grows boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From repeats sorted by document and place: those that touch as one run. A document's repeats are held at a time."""
    def united(b: pa.RecordBatch) -> pa.RecordBatch:
        th, lo, hi, rest, fat, skip, own, size = (b[c].to_numpy(zero_copy_only=False) for c in ("th", "lo", "hi", "rest", "fat", "skip", "own", "size"))
        n = len(th)
        new = np.r_[True, (th[1:] != th[:-1]) | ~_same(b["id"].slice(1), b["id"].slice(0, n - 1))]
        doc = np.cumsum(new) << 32
        reach = np.maximum.accumulate(doc + hi)
        start = np.flatnonzero(new | np.r_[True, (doc + lo)[1:] > reach[:-1]])
        run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
        top = np.maximum.reduceat(hi, start)
        last = np.minimum.reduceat(np.where(hi == top[run], np.arange(n), n), start)
        low, high = pa.array(start), pa.array(last)
        wall = np.where(own[start], fat[start] + size[start], 0)  # a run does not grow into its own first occurrence
        cols = [b["id"].take(low), b["th"].take(low), b["lo"].take(low), b["hi"].take(high), pa.array(wall.astype(np.int32)), pa.array((hi[last] - lo[last] + skip[last]).astype(np.int32)), pa.array(np.logical_or.reduceat(b["alike"].to_numpy(zero_copy_only=False), start) & ~np.logical_or.reduceat(own, start))]
        cols += [b[c].take(low) for c in ("h", "fth", "fat")] + [pa.array((lo[start] > 0) & (skip[start] == 0))] + [b[c].take(high) for c in ("h", "fth", "fat")] + [pa.array(rest[last] > 0)]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _RUN.split(", ")])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        th = b["th"].to_numpy()
        if held and held[-1]["th"][0].as_py() == th[-1]:
            held.append(b)
            continue
        last = int((th == th[-1]).argmax())
        whole = [*held, *([b.slice(0, last)] if last else [])]
        if whole:
            yield united(pa.Table.from_batches(whole).combine_chunks().to_batches()[0])
        held = [b.slice(last)]
    if held:
        yield united(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _contexts(wanted, docs, text: str):
    """The words around wanted chunks and keys, from documents set in the other bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(bit_set(docs.value, b["th"].to_numpy().view(np.uint64))))
            th = b["th"].to_numpy()
            for row, _, raw, off in text_slices(b[text], SLICE):
                lines = Lines(raw, off).hashed()
                a, e, h = lines.chunks()
                at, key = lines.grams()
                first, end, h = np.r_[a, at], np.r_[e, at + GRAM], np.r_[h, key]
                doc = np.searchsorted(lines.word_first, first, side="right") - 1
                place = first - lines.word_first[doc]
                ok = np.flatnonzero(bit_set(wanted.value, h ^ th[row + doc].view(np.uint64) ^ place.astype(np.uint64)))
                if len(ok):
                    first, end, doc, place = first[ok], end[ok], doc[ok], place[ok]
                    lo, hi = np.maximum(lines.word_first[doc], first - CONTEXT), np.minimum(lines.word_first[doc + 1], end + CONTEXT)
                    cols = [pa.array(h[ok].view(np.int64)), pa.array(th[row + doc]), pa.array(place.astype(np.int32)), lines.joined(lo, first), lines.joined(first, hi)]
                    yield pa.RecordBatch.from_arrays(cols, names=["h", "fth", "fat", "before", "after"])

    return run


def _texts(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("id"), _document(text, doc_id).alias("th"), F.col(text).alias("text"))


def _document(text: str, doc_id: str) -> Column:
    """A hash that tells documents: of the text, and of the id."""
    return F.xxhash64(F.xxhash64(text), F.xxhash64(doc_id), F.col(doc_id).isNull())


def repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, th, ranges): the runs of words of each document that repeat earlier ones, with the words that stand around the
    firsts of their ends. th tells the document's text and id."""
    spark = documents.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(documents, text, doc_id)
    packs = texts.select("text").mapInArrow(tidy(_hashes("text", BUCKETS * n)), "bucket int, packed binary")
    counts = checkpoint(packs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_repeated), "h long, count long"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    limit = max(HOT_ROWS, total // (n * HOT_SHARE))
    hot = counts.where(F.col("count") > limit).orderBy("h").toArrow()
    hot = (hot["h"].to_numpy(), -(-hot["count"].to_numpy() // limit))
    bitmap, spread = bitmap_of(counts.select("h")), spark.sparkContext.broadcast(hot)
    kind = texts.schema["id"].dataType.simpleString()
    met = _meet(texts.mapInArrow(tidy(_candidates(bitmap, spread, "text", "id")), _FOUND.format(id=kind)), spread, n, int(hot[1].max(initial=1)))
    place = ["th", "id", "lo", "hi", "h", "fth", "fat"]
    runs = checkpoint(met.repartition(n, "th").sortWithinPartitions(*place).mapInArrow(tidy(_runs), _RUN.format(id=kind)))
    bitmap.unpersist()  # its only reader is checkpointed
    first = ["h", "fth", "fat"]
    ends = [runs.where(f"{e}_grows").select("id", "th", "lo", "hi", F.lit(e == "low").alias("left"), *[F.col(f"{e}_{c}").alias(c) for c in first]) for e in ("low", "high")]
    ends = ends[0].unionByName(ends[1])
    asked = checkpoint(ends.groupBy(*first).agg(F.count("*").alias("asks")))
    wanted = bitmap_of(asked.select(F.col("h").bitwiseXOR(F.col("fth")).bitwiseXOR(F.col("fat").cast("long")).alias("h")))
    docs = bitmap_of(asked.select(F.col("fth").alias("h")))
    found = texts.select("th", "text").mapInArrow(tidy(_contexts(wanted, docs, "text")), "h long, fth long, fat int, before binary, after binary")
    # of documents that repeat one is enough
    around = checkpoint(found.groupBy(*first).agg(F.any_value("before").alias("before"), F.any_value("after").alias("after")))
    wanted.unpersist()
    docs.unpersist()
    # each first is copied to as many parts as its own repeats are dealt to, not to those of its hash, which has a first in each
    most = max(HOT_ROWS, (asked.agg(F.sum("asks")).first()[0] or 0) // (n * HOT_SHARE))
    parts = asked.where(F.col("asks") > most).select(*first, F.ceil(F.col("asks") / most).cast("int").alias("parts"))
    several = around.join(F.broadcast(parts), first, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = ends.join(F.broadcast(parts), first, "left").withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("th", "lo"), F.col("parts"))).otherwise(0).cast("int"))
    text_of = F.when(F.col("left"), F.col("before")).otherwise(F.col("after"))
    told = dealt.join(several, [*first, "salt"]).select("id", "th", "lo", "hi", F.col("left"), text_of.alias("words"))
    mine = runs.select("id", "th", "lo", "hi", "wall", "into", "alike", F.lit(None).cast("boolean").alias("left"), F.lit(None).cast("binary").alias("words"))
    every = mine.unionByName(told.withColumns({"wall": F.lit(0), "into": F.lit(0), "alike": F.lit(False)}))
    return every.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi", "wall", "into", "alike", "left", "words")).alias("ranges"))


def _grown(lines: Lines, doc: int, ranges: list[tuple], whole: float | None) -> list[list[int]]:
    """The runs of a document, grown over the words that equal those around their firsts; all of it if at least a share `whole` of its words is in runs that documents of a like length have too."""
    a, z = lines.word_first[doc], lines.word_first[doc + 1]
    word = lambda k: lines.raw[lines.word_start[k] : lines.word_end[k]].tobytes()
    runs = {(lo, hi): [lo, hi, wall, into, alike] for lo, hi, wall, into, alike, left, _ in ranges if left is None}
    for lo, hi, _, _, _, left, words in ranges:
        if not words:
            continue
        run, around = runs[lo, hi], words.split(b" ")
        if left:
            k, least = a + lo, a + run[2]  # a run does not grow into its own first occurrence
            while around and k > least and word(k - 1) == around.pop():
                k -= 1
            run[0] = k - a
        else:
            k, i = a + hi, run[3]
            while k < z and i < len(around) and word(k) == around[i]:
                k, i = k + 1, i + 1
            run[1] = k - a
    if whole is not None:
        words, reach = 0, 0
        for lo, hi, _, _, alike in sorted(runs.values()):
            if alike and hi > reach:
                words, reach = words + hi - max(lo, reach), hi
        if words and words >= whole * (z - a):
            return [[0, int(z - a)]]
    return [r[:2] for r in runs.values()]


def added(documents: DataFrame) -> tuple[str, str]:
    """The names of the columns that deduplicate adds to a frame."""
    return free_name(documents, "n_lines"), free_name(documents, "n_cut")


def deduplicate(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", whole: float | None = None) -> DataFrame:
    """documents with repeated passages cut from the text, and n_lines and n_cut (lines) added. With a share `whole`, a document
    that repeats others of a like length in so much of its words is left empty."""
    n_lines, n_cut = added(documents)
    th, told, hit, key, its_id = (free_name(documents, c) for c in ("th", "ranges", "hit", "key", "its_id"))
    found = checkpoint(repeats(documents, text, doc_id)).withColumnsRenamed({"id": its_id, "th": key, "ranges": told})
    keyed = marked(documents.withColumn(th, _document(text, doc_id)), th, found.select(F.col(key).alias("h")), hit)
    schema = StructType(list(documents.schema.fields)).add(n_lines, "long").add(n_cut, "long")
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b[told].fill_null([])
            fields, edges = list(zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True)), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
            made: list[pa.Array] = []
            counts: list[list[np.ndarray]] = [[], []]
            for row, n_rows, raw, off in text_slices(b[text], SLICE):
                lines = Lines(raw, off)
                doc, lo, hi = [], [], []
                for k in range(n_rows):
                    for x, y in _grown(lines, k, fields[edges[row + k] : edges[row + k + 1]], whole):
                        doc.append(k)
                        lo.append(x)
                        hi.append(y)
                edge = np.zeros(len(raw) + 1, np.int32)
                at = np.array(doc, np.int64)
                np.add.at(edge, lines.cut_at(np.array(lo, np.int64), at), 1)
                np.add.at(edge, lines.cut_at(np.array(hi, np.int64), at), -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = np.r_[0, np.cumsum(~gone)]
                lost = np.diff(left[np.r_[lines.start, len(raw)]]) < lines.end - lines.start
                counts[0].append(np.diff(lines.first))
                counts[1].append(np.diff(np.r_[0, np.cumsum(lost)][lines.first]))
                made.append(pa.Array.from_buffers(pa.large_string(), n_rows, [None, pa.py_buffer(left[off].astype(np.int64)), pa.py_buffer(raw[~gone])]))
            texts = pa.concat_arrays(made) if made else pa.array([], pa.large_string())
            if b[text].null_count:
                texts = pc.if_else(pc.is_null(b[text]), pa.scalar(None, pa.large_string()), texts)
            new = {text: texts.cast(pa.string())} | {c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in zip((n_lines, n_cut), counts, strict=True)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b[c] for c in schema.names], names=schema.names)

    joined = keyed.where(hit).join(found, (F.col(th) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(its_id)), "left").select(*names, told)
    content = F.coalesce(F.col(text), F.lit(""))
    unended = (content != "") & (F.right(content, F.lit(1)) != "\n") & ~F.right(content, F.lit(2)).isin(". ", "! ", "? ")
    plain = keyed.where(~F.col(hit)).select(*names, (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + F.regexp_count(content, F.lit("[.!?] ")) + unended.cast("int")).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_cut))
    return joined.mapInArrow(tidy(run), schema).unionByName(plain)


def digest(documents: DataFrame) -> DataFrame:
    """Per document: lines, lines cut, characters left and a digest of the text left."""
    out = deduplicate(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_cut", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
