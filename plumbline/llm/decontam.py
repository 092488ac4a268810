"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words (k = 5); of every run of 4 neighbouring
k-grams the smallest hash is kept, so every shared span of 5 + 4 - 1 = 8 words has
a fingerprint in common. The fingerprints of documents that the benchmark has too are
extended to the 8-word windows around them, and these are joined with the windows of the
benchmark, byte by byte. A benchmark item shorter than a window is one window itself;
winnowing promises nothing there, so those lengths (seven at most) are looked up at every
position.

Nothing of the benchmark is collected but two bitmaps of fixed size: of its fingerprints
and of its windows' hashes, which let only windows through that the benchmark holds, or a
few per cent more if it is very large. Windows meet in an equi-join that Spark broadcasts
if one side is small and shuffles if not. What a document is found to hold is joined back
by three hashes of its text; a document without any does not travel.

Nulls: a null text has no words; a benchmark row without id counts for the words hit
but is no item. Rows that repeat, also with the same id, are each answered alike, as are
empty tables. Columns of the input that are named as those added (n_words, n_hit, items)
keep their names, and the added ones get an underscore more; other names are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from .common import Words, bit_set, bitmap_of, distinct, free_name, gram_hashes, joined, marked, ship, text_slices, tidy

WINDOW, GRAM = 8, 5
#: All ASCII characters that are in no word, one by one, which Java matches faster than ranges. Upper and lower case are
#: alike here, so the text needs no lower-casing to be counted.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]++"


def _winnow(g: np.ndarray, run: int, end: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash, the rightmost of equals, of every `run` neighbours; end: where each position's text ends."""
    n = len(g) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, run):
        less = g[j : n + j] <= best
        best[less] = g[j : n + j][less]
        at[less] = np.flatnonzero(less) + j
    at = at[np.arange(n) + run <= end[:n]]
    return at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])] if len(at) and (np.diff(at) >= 0).all() else distinct(at)


def fingerprints(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the winnowed k-grams of a slice of texts."""
    g = gram_hashes(w.hash, gram)
    at = _winnow(g, window - gram + 1, w.last()[: len(g)] - gram + 1)
    return at, g[at]


def _tagged(h: np.ndarray, n: int) -> np.ndarray:
    return h ^ np.uint64(n * 0x9E3779B97F4A7C15 & 2**64 - 1)


def windows(benchmark: DataFrame, item: str, text: str, window: int, gram: int) -> DataFrame:
    """(item, n, h, words, prints) of every window of the benchmark, with the fingerprints of its item in the first one's row."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, raw, off in text_slices(b["text"]):
                w = Words(raw, off)
                of, prints = fingerprints(w, window, gram)
                for n in range(1, window + 1):
                    if n < window:
                        at = w.first[:-1][w.count == n]
                    else:
                        at = np.flatnonzero(np.arange(len(w)) + n <= w.last())
                    if not len(at):
                        continue
                    h = _tagged(gram_hashes(w.hash, n, at), n)
                    mine = np.searchsorted(of, at), np.searchsorted(of, np.r_[at[1:], len(w)])
                    for s in range(0, len(at), 8192):
                        k = slice(s, s + 8192)
                        lists = [prints[x:y].view(np.int64).tolist() if n == window else [] for x, y in zip(mine[0][k].tolist(), mine[1][k].tolist(), strict=True)]
                        doc = row + np.searchsorted(w.first, at[k], side="right") - 1
                        cols = [b["item"].take(pa.array(doc)), pa.array(np.full(len(doc), n, np.int32)), pa.array(h[k].view(np.int64)), joined(w.low, w.start, w.end, at[k], at[k] + n), pa.array(lists, pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(cols, names=["item", "n", "h", "words", "prints"])

    return rows.mapInArrow(tidy(run), "item string, n int, h long, words binary, prints array<long>")


def _found(prints, known, short: list[int], window: int, gram: int):
    """Windows of documents whose hash is set in the bitmap, with their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, raw, off in text_slices(b["text"]):
                w = Words(raw, off)
                if not len(w):
                    continue
                at, h = fingerprints(w, window, gram)
                at = at[bit_set(prints.value, h)]
                first = w.first[np.searchsorted(w.first, at, side="right") - 1]
                around = at[:, None] - np.arange(window - gram + 1)[None, :]
                last = w.last()
                for n, places in [(window, distinct(around[around >= first[:, None]])), *((n, np.arange(len(w))) for n in short)]:
                    places = places[places + n <= last[places]]
                    places = places[bit_set(known.value, _tagged(gram_hashes(w.hash, n, places), n))]
                    for s in range(0, len(places), 8192):
                        p = places[s : s + 8192]
                        doc = np.searchsorted(w.first, p, side="right") - 1
                        take = pa.array(row + doc)
                        cols = [*(b[c].take(take) for c in ("t1", "t2", "t3")), pa.array((p - w.first[doc]).astype(np.int32)), pa.array(np.full(len(p), n, np.int32)), joined(w.low, w.start, w.end, p, p + n)]
                        yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "t3", "at", "n", "words"])

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 1, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """documents with n_words, n_hit, items (sorted ids as strings) added; see the module's notes. Items of fewer words than `least` are left out."""
    spark = documents.sparkSession
    ship(spark)
    of_benchmark = checkpoint(windows(benchmark, item, item_text, window, gram).where(F.col("n") >= least))
    short = [r["n"] for r in of_benchmark.where(F.col("n") < window).select("n").distinct().collect()]  # seven at most
    prints, known = bitmap_of(of_benchmark.select(F.explode("prints").alias("h"))), bitmap_of(of_benchmark.select("h"))
    by_words = of_benchmark.groupBy("n", "words").agg(F.collect_set("item").alias("items"))
    hashes = lambda c: (F.xxhash64(c), F.hash(c), F.octet_length(c))
    rows = documents.select(*[h.alias(f"t{k + 1}") for k, h in enumerate(hashes(text))], F.col(text).alias("text"))
    found = rows.mapInArrow(tidy(_found(prints, known, short, window, gram)), "t1 long, t2 int, t3 int, at int, n int, words binary").dropDuplicates(["t1", "t2", "t3", "at", "n"])
    hit = found.join(by_words, ["n", "words"]).groupBy("t1", "t2", "t3").agg(F.collect_list(F.struct("at", "n")).alias("spans"), F.collect_set("items").alias("lists"))
    end = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.struct(F.greatest(a["end"], x["at"] + x["n"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["end"], x["at"]))).alias("sum")))
    n_words, n_hit, items = (free_name(documents, c) for c in ("n_words", "n_hit", "items"))
    keys, flag = [free_name(documents, f"t{k}") for k in (1, 2, 3)], free_name(documents, "hit")
    theirs = [free_name(documents, f"{k}_of") for k in keys]
    hit = hit.select(*[F.col(f"t{k + 1}").alias(theirs[k]) for k in range(3)], end["sum"].alias(n_hit), F.array_sort(F.array_distinct(F.flatten("lists"))).alias(items))
    hit = checkpoint(hit)
    prints.unpersist()
    known.unpersist()
    keyed = marked(documents.withColumns(dict(zip(keys, hashes(text), strict=True))), keys[0], hit.select(F.col(theirs[0]).alias("h")), flag)
    on = [F.col(a) == F.col(b) for a, b in zip(keys, theirs, strict=True)]
    none = F.array().cast("array<string>")
    some = keyed.where(flag).join(hit, on, "left").select(*documents.columns, F.coalesce(n_hit, F.lit(0).cast("long")).alias(n_hit), F.coalesce(items, none).alias(items))
    plain = keyed.where(~F.col(flag)).select(*documents.columns, F.lit(0).cast("long").alias(n_hit), none.alias(items))
    return some.unionByName(plain).select(*documents.columns, F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias(n_words), n_hit, items)


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract of op4: counts of words hit and items found, and a digest of the items' ids."""
    out = decontaminate(documents.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, lens WHERE len(w) >= n),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.g = array_to_string(list_slice(w, i, i + dw.n - 1), ' ')),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
