"""op5 and op10 against the tokenizers library, op2 and op4 against SQL and by hand."""

import hashlib

import pandas as pd
import pytest
from compare import same, view
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, chat, decontam, pretokens, queries, tokencount

ODD = [
    None, "", "  \n\t ", "a", "A" * 5000, "<|startoftext|>x<|endoftext|> <|endoftext|>", "don't we'll L'ÉTÉ ×÷ ÀÈ ß İ é é", "你好 123 4.5", "x y z\x85", "<|", "<|start", "ab\x00cd \x1c x\x1d", "ÿþ Ÿ� 🙂🙂",
    "a'b's'S 'LL", "x" * 300 + " " + "é" * 300, "ǅ ǆ ﬁ Ⅷ ½", "ÀÀ12''ab", "mix<|endoftext|>mix é<|endoftext|>", "tab\tnew\nline\x0bv\x0cf", "a", "supercalifragilisticexpialidocious" * 40,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(pretokens.word_bpe())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(ODD)], "doc_id long, text string, lang string")


def wanted(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)), ids


@pytest.mark.parametrize("step", [1 << 22, 64])
def test_bpe_is_the_librarys(spark, small, library, odd, step, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, small).collect()}
    for d in docs:
        assert tuple(got[d["doc_id"]])[1:] == wanted(library, d["text"])[:3]
    for r in bpe.digest(odd).collect():
        assert tuple(r)[1:] == wanted(library, ODD[r["doc_id"]])[:3]


def test_bpe_texts_and_ids(odd, library):
    back = bpe.decode(bpe.encode(odd)).collect()
    for r in back:
        *_, ids = wanted(library, ODD[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["lang"] == "en" and r["text"] == ODD[r["doc_id"]]


def test_long_texts_are_written_in_steps(library, monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe, "WRITTEN", 7)
    e = bpe._encoder(pretokens.word_bpe())
    texts = [t or "" for t in ODD]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    ids, n = e.encode(np.frombuffer(raw, np.uint8), off)
    assert bpe._digests(e.digits, ids, n) == [wanted(library, t)[1] for t in texts] and bpe._digests(e.words, ids, n) == [wanted(library, t)[2] for t in texts]


def test_counts_are_the_librarys(spark, small, library, odd):
    for d, r in zip(spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect(), queries.op10_token_counts(spark, small).orderBy("doc_id").collect(), strict=True):
        n = wanted(library, d["text"])[0]
        assert tuple(r) == (d["doc_id"], len((d["text"] or "").encode()), n, n > 2048)
    for r in tokencount.count_tokens(odd, limit=3).collect():
        n = wanted(library, ODD[r["doc_id"]])[0]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((ODD[r["doc_id"]] or "").encode()), n > 3)


def test_taken_names_and_empty_tables(spark, odd):
    clashing = odd.withColumnRenamed("lang", "N_Tokens").withColumn("ids", F.lit(0))
    encoded = bpe.decode(bpe.encode(clashing), ids="ids_", out="N_tokens")
    assert encoded.columns == [*clashing.columns, "ids_", "N_tokens_"] and encoded.where("ids <> 0").isEmpty()
    counted = tokencount.count_tokens(clashing)
    assert counted.columns == [*clashing.columns, "n_bytes", "n_tokens_", "over_limit"] and bpe.round_trip(clashing).columns[-3:] == ["n_tokens_", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"]: r["n_tokens_"] for r in counted.collect()} == {r["doc_id"]: len(r["ids_"]) for r in encoded.collect()} == {r["doc_id"]: r["n_tokens"] for r in tokencount.digest(odd).collect()}
    none = odd.limit(0)
    assert bpe.digest(none).count() == tokencount.digest(none).count() == bpe.encode(none).count() == 0
    twice = odd.unionByName(odd)
    assert bpe.digest(twice).count() == 2 * len(ODD) and bpe.digest(twice).distinct().count() == len(ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), view(small), queries.ORACLES[name])


# --- op2 ---------------------------------------------------------------------


def test_chat_round_trips_anything(spark):
    texts = ["<|turn|>", "␛", "␛e<|text|>", "</s>[INST] ok [/INST]", "", None, "<|end|>" * 50, "<␛|turn|>", "[␛INST]", "🙂 é", "<|im_start|>user", "x" * 3000]
    rows = [(k % 3, k // 3, ["user", "assistant", "sys<|text|>tem", None][k % 4], t) for k, t in enumerate(texts * 3)] + [(None, 0, "assistant", "a"), (7, None, "assistant", "b"), (7, 1, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    from compare import rows as _  # noqa: F401

    want: dict = {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _t, role, text in sorted([*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], key=order):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for piece in chat.format_conversations(df).collect():
        assert len(piece["ids"]) == len(piece["loss_mask"]) and chat.parse(piece["formatted"])
    assert {r["conv_id"] for r in chat.digest(df.limit(0)).collect()} == {-1}


def test_chat_pieces_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 50)
    df = pd.DataFrame({"conv_id": 1, "turn": range(40), "role": ["user", "assistant"] * 20, "text": [f"turn {k} <|end|> text" for k in range(40)]})
    rows = [(r.role, r.text) for r in df.itertuples()]
    import pyarrow as pa

    out = list(chat._pieces(iter([pa.RecordBatch.from_pandas(df)])))
    assert len(out) > 10 and [t for _, ts, _ in out for t in ts] == rows and [x for *_, x in out].count(True) == 1


# --- op4 ---------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_decontamination_cases(spark, broadcast):
    words = [f"w{k}" for k in range(40)]
    bench = [("a", " ".join(words[:12])), ("b", "Short ITEM"), ("c", None), ("d", "..."), (None, "w30 w31 w32 w33 w34 w35 w36 w37"), ("a", "w20 w21 w22 w23 w24 w25 w26 w27 w28")]
    docs = [
        (1, "x " + " ".join(words[2:10]) + " y"), (2, " ".join(words[2:9])), (3, "a short--item, here. short item"), (4, None), (5, ""), (6, "W30-w31 w32 w33 w34 w35 w36 w37 short item"), (7, " ".join(words[20:29] * 2)), (8, "shortitem"), (None, "short item"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id string, text string")
    want = {1: (10, 8, ["a"]), 2: (7, 0, []), 3: (6, 4, ["b"]), 4: (0, 0, []), 5: (0, 0, []), 6: (10, 10, ["b"]), 7: (18, 18, ["a"]), 8: (1, 0, []), None: (2, 2, ["b"])}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(d, b).collect()}
        long = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(d, b, least=decontam.WINDOW).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and long == {k: {3: 0, 6: 8, None: 0}.get(k, v[1]) for k, v in want.items()}
    assert decontam.decontaminate(d, b.limit(0)).where("n_hit > 0").count() == 0 and decontam.decontaminate(d.limit(0), b).count() == 0
    clashing = d.withColumns({c: F.lit(c) for c in ("Items", "n_words", "t1", "hit", "words")})
    again = decontam.decontaminate(clashing, b)
    assert again.columns == [*clashing.columns, "n_words_", "n_hit", "items_"]
    assert {r["doc_id"]: (r["n_words_"], r["n_hit"], r["items_"]) for r in again.where("Items = 'Items' and n_words = 'n_words'").collect()} == want
