"""op3, op6 and op8 against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import ann, linededup, queries, simhash


def brute_print(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints):
    """prints: {id: fingerprint} -> {id: smallest id reachable}"""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_is_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    prints = {d["doc_id"]: brute_print(d["text"]) for d in docs}
    comps = brute_components(prints)
    got = queries.op6_simhash(spark, small).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {i: (prints[i], comps[i]) for i in prints} and len(got) == len(docs)


def test_hashes_are_the_librarys():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    size = np.r_[np.arange(100), rng.integers(0, 40, 900)]
    start = np.r_[rng.integers(0, 3900, 999), 4000 - size[-1]]
    for seed in (0, 42):
        assert simhash.xxh64(data, start, size, seed).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) for a, n in zip(start, size, strict=True)]


def test_near_prints_share_a_key():
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(4000)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for x in base]
    fp = np.array(base + near, np.uint64)
    met = set()
    by: dict = {}
    for key, at, side in simhash.keys(fp):
        for k, i in zip(key.tolist(), at.tolist(), strict=True):
            by.setdefault(k, []).append((side, i))
    for group in by.values():
        for s, i in group:
            for t, j in group:
                if (s == t == 0) or (s != t):
                    met.add((i, j))
    assert all((k, k + 4000) in met or (k + 4000, k) in met for k in range(4000))


@pytest.fixture
def small_batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("block, small_batches", [(4096, 10_000), (5, 10_000), (5, 3)], indirect=["small_batches"])
def test_links_of_dense_groups(spark, monkeypatch, block, small_batches):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(60):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    want = brute_components(dict(enumerate(prints)))
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in prints]
    from plumbline.operators.graph import components

    roots = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    classes: dict = {}
    for i, x in enumerate(prints):
        classes.setdefault(want[i], set()).add(x)
    found: dict = {}
    for x in prints:
        found.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))


def test_simhash_cases(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(5, long, "a"), (3, long.upper(), "b"), (9, None, "c"), (7, "", "d"), (8, "one", "e"), (None, long, "f"), (5, long, "a"), (6, "two words", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = {(r["doc_id"], r["tag"]): r["component_id"] for r in simhash.near_duplicates(df, extra=["tag"]).collect()}
    assert got[(5, "a")] == got[(3, "b")] == got[(None, "f")] == 3 and got[(9, "c")] == got[(7, "d")] == 7 and got[(8, "e")] == 8 and got[(6, "g")] == 6
    kept = simhash.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 7, 8] and kept.columns == df.columns
    assert simhash.digest(df.limit(0)).count() == 0
    clashing = df.withColumnRenamed("tag", "fp").withColumns({c: F.lit(c) for c in ("root", "Least", "node", "component_id", "th", "id")})
    again = simhash.near_duplicates(clashing, extra=["fp", "root", "Least", "component_id"])
    assert {(r["doc_id"], r["fp"]): r["component_id_"] for r in again.where("root = 'root' and component_id = 'component_id'").collect()} == got
    assert sorted(r["doc_id"] for r in simhash.keep_one(clashing).collect()) == [3, 6, 7, 8] and simhash.keep_one(clashing).columns == clashing.columns


def test_one_of_each_component_without_ids_and_with_one_id_on_two_texts(spark):
    rng = random.Random(13)
    a, b, c, d = (sentence(rng, 200) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (None, c), (4, c), (1, d), (2, a.upper() + " "), (2, d), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # b has no other row; the rows that repeat are one row; d keeps 1 only, though 2 is kept for another text
    assert sorted(map(tuple, kept), key=repr) == sorted([(2, a.upper() + " "), (None, b), (None, b), (4, c), (1, d), (None, None)], key=repr)


# --- op3 ---------------------------------------------------------------------


def sentence(rng, n=12):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)).capitalize() + "."


def test_repeated_passages_go_and_first_ones_stay(spark):
    rng = random.Random(3)
    passage = " ".join(sentence(rng) for _ in range(6))
    rows, clean = [], []
    for k in range(40):
        own = [" ".join(sentence(rng) for _ in range(4)) for _ in range(2)]
        rows.append((k, f"{own[0]} {passage} {own[1]}" if k % 2 else "\n".join(own)))
        if k % 2 == 0:
            clean.append(k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.deduplicate(df.repartition(5)).collect()}
    texts = dict(rows)
    body = passage[20:-20]
    assert all(got[k]["text"] == texts[k] and got[k]["n_cut"] == 0 for k in clean)
    assert got[1]["text"] == texts[1]  # the first has it still
    for k in range(3, 40, 2):
        assert body not in got[k]["text"] and got[k]["n_cut"] >= 4
        left = got[k]["text"]
        assert all(part in texts[k] for part in left.split(". ")) and len(left) > 100


def test_copies_and_cases(spark, monkeypatch):
    rng = random.Random(4)
    text = "\n".join(sentence(rng) for _ in range(30))
    rows = [(2, text), (1, text), (3, None), (4, ""), (5, "short line\nshort line\n"), (None, text), (2, text), (6, "x" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit(1))
    want = None
    for hot in (5000, 1):  # the second sends every repeated chunk through the salted way
        monkeypatch.setattr(linededup, "HOT_ROWS", hot)
        monkeypatch.setattr(linededup, "HOT_SHARE", 10**9 if hot == 1 else 100_000)
        got = sorted(((r["doc_id"], r["text"], r["n_cut"]) for r in linededup.deduplicate(df).collect()), key=repr)
        want = want or got
        assert got == want
    by = {}
    for i, t, n in got:
        by.setdefault(i, []).append((t, n))
    assert by[None] == [(text, 0)] and by[1][0][0] == "" and by[2] == [("", 30)] * 2 and by[3] == [(None, 0)] and by[4] == [("", 0)] and by[6][0][1] == 0
    assert by[5] == [("short line\nshort line\n", 0)]
    assert linededup.digest(df.limit(0)).count() == 0
    clashing = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("N_cut", "n_lines", "th", "ranges", "hit", "h", "id"))])
    again = linededup.deduplicate(clashing)
    assert again.columns == [*clashing.columns, "n_lines_", "n_cut_"] and sorted(((r["doc_id"], r["text"], r["n_cut_"]) for r in again.collect()), key=repr) == want
    assert {tuple(r)[3:10] for r in again.collect()} == {tuple(range(7))}


def test_chunk_hashes_do_not_depend_on_place():
    rng = random.Random(5)
    lines = [sentence(rng) for _ in range(50)]
    hashes = []
    for front in ("", "Something else stands here. ", "a b c\n" * 7):
        raw = (front + "\n".join(lines)).encode()
        x = linededup.Lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashed()
        hashes.append({int(h) for h in x.chunks()[2]})
    assert len(hashes[0]) > 10 and len(hashes[0] & hashes[1]) >= len(hashes[0]) - 4 and len(hashes[0] & hashes[2]) >= len(hashes[0]) - 4


def copied(spark, passages, gap=" ", own=None):
    """What line dedup leaves of the first and the second of two texts around each passage, with what stands before and after."""
    rng = random.Random(6)
    own = own or (lambda: " ".join(sentence(rng) for _ in range(4)))
    parts = [(own(), p, own()) for p in passages for _ in range(2)]
    df = spark.createDataFrame([(k, gap.join(x)) for k, x in enumerate(parts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(df).collect()}
    return [(got[k], got[k + 1], parts[k], parts[k + 1]) for k in range(0, len(parts), 2)]


@pytest.mark.parametrize("sentences, words", [(3, 18), (4, 13), (5, 11)])
def test_no_shared_run_of_51_words_is_missed(spark, sentences, words):
    rng = random.Random(8)
    passages = [" ".join(sentence(rng, words) for _ in range(sentences)) for _ in range(25)]
    for first, second, a, (front, passage, back) in copied(spark, passages):
        assert first == " ".join(a) and second.startswith(front) and second.endswith(back)
        left = passage.split()
        assert not any(" ".join(left[k : k + 51]) in second for k in range(len(left) - 50))


@pytest.mark.parametrize("hot", [5000, 1])
def test_near_copies_are_cut_whole_if_asked(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_ROWS", hot)
    monkeypatch.setattr(linededup, "HOT_SHARE", 10**9 if hot == 1 else 16)
    rng = random.Random(14)
    base = " ".join(sentence(rng, 9) for _ in range(20)).split()
    near = [list(base) for _ in range(4)]
    for k, text in enumerate(near):
        text[70 + 2 * k] = f"other{k}"
    passage, tail = " ".join(base[:80]), sentence(rng, 5)
    rows = [(0, " ".join(base)), *[(k + 1, " ".join(t)) for k, t in enumerate(near)], (5, f"{passage} {tail}"), (6, " ".join(sentence(rng, 9) for _ in range(20)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(df, whole=linededup.WHOLE).collect()}
    # a short text with a passage of a longer one is no near copy of it
    assert got == {0: rows[0][1], 1: "", 2: "", 3: "", 4: "", 5: tail, 6: rows[6][1]}
    plain = {r["doc_id"]: r["text"] for r in linededup.deduplicate(df).collect()}
    assert all("other" in plain[k] and len(plain[k]) < len(rows[k][1]) / 4 for k in range(1, 5)) and plain[5] == tail


@pytest.mark.parametrize("lines, words", [(26, 2), (52, 1), (18, 3), (30, 3)])
@pytest.mark.parametrize("hot", [5000, 1])
def test_short_lines_go_to_their_full_extent(spark, monkeypatch, lines, words, hot):
    monkeypatch.setattr(linededup, "HOT_ROWS", hot)
    monkeypatch.setattr(linededup, "HOT_SHARE", 10**9 if hot == 1 else 100_000)
    rng = random.Random(9)
    passages = ["\n".join(sentence(rng, words)[:-1] for _ in range(lines)) for _ in range(12)]
    for first, second, a, (front, _, back) in copied(spark, passages, "\n"):
        assert first == "\n".join(a) and second == f"{front}\n{back}"


def generated(spark, monkeypatch, dedup, sizes):
    """Rows that explode makes while dedup runs on groups of so many documents with one passage in common."""
    monkeypatch.setattr(linededup, "HOT_ROWS", 2)
    monkeypatch.setattr(linededup, "HOT_SHARE", 100_000)
    plain, made = linededup.checkpoint, []

    def counted(df):
        out, nodes = plain(df), [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Generate":
                made[-1] += node.metrics().apply("numOutputRows").value()
            nodes += [node.children().apply(k) for k in range(node.children().size())]
        return out

    monkeypatch.setattr(linededup, "checkpoint", counted)
    rng = random.Random(15)
    passage = sentence(rng, 80)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans with metrics that can be walked
    try:
        for n in sizes:
            rows = [(k, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}") for k in range(n)]
            made.append(0)
            got = {r["doc_id"]: r["text"] for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            assert got[0] == rows[0][1] and not any(passage in got[k] for k in range(1, n))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return made


def test_firsts_are_copied_no_more_often_than_they_are_asked_for(spark, monkeypatch):
    few, many = generated(spark, monkeypatch, linededup.deduplicate, (40, 160))
    assert 0 < few and many < 6 * few


def test_firsts_are_copied_no_more_often_in_the_pipeline(spark, monkeypatch):
    few, many = generated(spark, monkeypatch, lambda docs: corpus_pipeline._line_dedup(spark, docs, ""), (40, 160))
    assert 0 < few and many < 6 * few, f"{few} rows made, {many} of four times the documents"


def test_the_first_of_words_in_a_loop_stays(spark):
    rng = random.Random(10)
    loop = sentence(rng, 7)[:-1].split()
    got = linededup.deduplicate(spark.createDataFrame([(1, " ".join(loop * 30))], "doc_id long, text string")).first()
    left = got["text"].split()
    assert left == (loop * 30)[: len(left)] and linededup.GRAM <= len(left) < linededup.GRAM + 7


def test_passages_without_ascii_full_stops(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(sentence(rng, n)[:-1].lower().split())
    for make, own, gap in (
        (lambda: words(60), lambda: words(40), " "),
        (lambda: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60)), lambda: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(40)), ""),
        (lambda: " ".join("".join(chr(rng.randint(0x905, 0x939)) for _ in range(5)) + "\u0964" * (k % 9 == 8) for k in range(60)), lambda: words(40), " "),
    ):
        for first, second, a, (front, _, back) in copied(spark, [make() for _ in range(12)], gap, own):
            assert first == gap.join(a) and second == f"{front}{gap}{back}"


# --- op8 ---------------------------------------------------------------------


def exact(ids, x, asks, k):
    s = x[asks].astype(np.float64) @ x.astype(np.float64).T
    out = {}
    for row, i in zip(s, asks, strict=True):
        order = np.lexsort((ids, -row))
        out[int(ids[i])] = [int(ids[j]) for j in order if j != i][:k]
    return out


def test_recall_on_the_small_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    want = exact(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    got: dict = {}
    for r in queries.op8_nearest(spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(set(v) & set(want[q])) for q, v in got.items()) / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("kind", ["clusters", "norms", "noise", "two_levels"])
def test_recall_of_the_index(spark, kind, monkeypatch):
    """The sample is a sixth of the rows and its vectors are no answers by themselves, so this is the lists' recall."""
    monkeypatch.setattr(ann, "LEAST_SAMPLE", 1024)
    monkeypatch.setattr(ann, "FLAT", 16 if kind == "two_levels" else 2048)
    rng = np.random.default_rng(1)
    n = 20_000
    x = rng.normal(size=(n, 32)) + (rng.normal(size=(40, 32)) * 2)[rng.integers(0, 40, n)] * (kind != "noise")
    if kind == "norms":
        x *= rng.lognormal(0, 0.5, n)[:, None]
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    asks = np.arange(0, n, 20)
    want = exact(np.arange(n), x, asks, 20)
    fitted = ann.fit(x[rng.permutation(n)[:2264]], n, float(np.linalg.norm(x, axis=1).max()), 21)
    assert fitted.probes < 0.8 * len(fitted.centroids) and len(fitted.bound) < 300
    hit, scores = 0, 0.0
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        hit += r["vec_id"] in want[r["query_id"]]
        scores = max(scores, abs(r["score"] - float(x[r["query_id"]].astype(np.float64) @ x[r["vec_id"]].astype(np.float64))))
    assert hit / (20 * len(asks)) >= 0.9 and scores < 1e-9


def test_copies_of_a_vector_are_one(spark):
    """A third of the rows hold one vector, some ids two, rows repeat: answers are exact where all lists are probed."""
    rng = np.random.default_rng(3)
    x = np.r_[np.tile(rng.normal(size=8), (100, 1)), rng.normal(size=(150, 8))]
    ids = np.r_[rng.permutation(240), np.arange(10)]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    got: dict = {}
    for r in ann.digest(spark.createDataFrame(rows * 3, "vec_id long, embedding array<double>").repartition(5)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i in range(0, 240, 20):
        best: dict = {}
        for q in x[ids == i]:
            for j, s in zip(ids.tolist(), ((x * q).sum(axis=1)).tolist(), strict=True):
                if j != i:
                    best[j] = max(s, best.get(j, -np.inf))
        want = sorted(((round(-s, 9), j) for j, s in best.items()))[:20]
        assert [j for j, _ in got[i]] == [j for _, j in want] and max(abs(s + w) for (_, s), (w, _) in zip(got[i], want, strict=True)) < 1e-8


def test_doubles_other_lengths_and_clashing_columns(spark):
    rows = [(0, [0.17, 0.0], 1, 2), (1, [1.0, 0.5], 1, 2), (20, [0.3, 0.0, 1.0], 1, 2), (2, [1.0, 1.0, 1.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, id int")
    got = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in ann.digest(df).collect()}
    assert got == {(0, 1, 1): 0.17, (20, 1, 2): 1.3}


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0]), (9, [1.0, 0.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.digest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9), (0, 2, 10), (0, 3, 20), (20, 1, 0), (20, 2, 9), (20, 3, 10)]
    assert ann.digest(df.limit(0)).count() == 0
