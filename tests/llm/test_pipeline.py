"""The pipeline's stages, each on what the one before kept, and as a whole against the stages' own brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import queries


def test_stages_in_order(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert len(rows) <= before and len({r["doc_id"] for r in rows}) == len(rows)
        before = len(rows)
        if name != "bpe":
            assert docs.columns == names
        if name == "toxicity":
            assert all(r["text"] == texts[r["doc_id"]] for r in rows) and len(rows) > 0.8 * len(texts)
    whole = queries.pipeline(spark, small)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def sentence(rng, n=11):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents, copies, near copies, a shared passage and a benchmark passage."""
    at = str(tmp_path_factory.mktemp("planted"))
    rng = random.Random(7)
    body = lambda n=12: " ".join(sentence(rng) for _ in range(n))
    rows = {k: body() for k in range(60)}
    bench = [body(4) for _ in range(5)]
    shared = body(8)
    for k in range(100, 106):
        rows[k] = rows[0]
    for k in range(110, 114):
        words = rows[1].split()
        words[len(words) // 2] = f"changed{k}"
        rows[k] = " ".join(words)
    for k in range(120, 125):
        rows[k] = f"{body(5)} {shared} {body(5)}"
    for k, b in enumerate(bench):
        rows[130 + k] = f"{body(5)} {b} {bench[(k + 1) % 5]} {body(5)}"
    documents = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, shared


def test_planted_cases(spark, planted):
    at, rows, shared = planted
    kept = {}
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at).persist()
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept["toxicity"]) == set(rows)  # nothing is known to be toxic
    assert sum(shared[30:-30] in r["text"] for r in kept["line_dedup"].values()) == 1
    assert all(kept["bpe"].get(k) is not None for k in range(60)), "clean documents stay"
    # line dedup left the copies empty; one empty document stands for all
    left = [k for k in range(100, 106) if k in kept["simhash"]]
    assert len(left) <= 1 and all(kept["simhash"][k]["text"] == "" for k in left)
    # near copies are cut whole, so that they go with the copies
    assert all(kept["line_dedup"][k]["text"] == "" for k in range(110, 114)) and len([k for k in (*range(100, 106), *range(110, 114)) if k in kept["simhash"]]) <= 1
    passages = [r["text"][30:-30] for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    assert not any(p in r["text"] for p in passages for r in kept["decontamination"].values()) and 130 not in kept["decontamination"]
    assert set(range(120, 125)) <= set(kept["bpe"])
    # on documents that nothing was cut from, each group keeps one
    alone = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()}
    assert not alone & set(range(100, 106)) and set(range(60)) <= alone


def test_stages_on_odd_documents(spark, planted):
    """Columns of any names pass, no n_chars is needed, and documents without id or text, with one id, or repeated are kept by the rules."""
    at, rows, _ = planted
    rng = random.Random(11)
    fresh = [" ".join(sentence(rng) for _ in range(12)) for _ in range(3)]
    odd = [(None, fresh[0]), (None, None), (7, fresh[1]), (7, fresh[2]), (8, ""), (9, "word " * 30_000), (0, rows[0]), (0, rows[0])]
    clashing = ("n_words", "N_hit", "items", "n_lines", "n_cut", "n_tokens", "ids_sha256", "score", "fp", "root", "th", "hit", "ranges", "spans")
    docs = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", *[F.lit(c).alias(c) for c in clashing])
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at).persist()
        kept[name] = docs.collect()
        assert all(r[c] == c for r in kept[name] for c in clashing)
        assert docs.columns == names or name == "bpe" and set(clashing) <= set(docs.columns)
    assert len(kept["toxicity"]) == len(kept["line_dedup"]) == len(odd)
    last = [(r["doc_id"], r["text"]) for r in kept["decontamination"]]
    assert {(None, fresh[0]), (7, fresh[1]), (7, fresh[2])} <= set(last)
    # documents without words are one group, and a row that repeats in full is one document
    assert sum(not (t or "").strip() for _, t in last) == 1 and last.count((0, rows[0])) == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, at)
        assert empty.count() == 0
