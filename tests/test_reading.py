import bz2
import gzip
import io
import lzma
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.sources.reading import ROW_ID, read_files

CSV = "a, b,c\n1,x,inf\n,,\na,b,c\n2.5,,-Infinity\nnan,\"q, r\",3\n"


def table(spark, paths, **kw):
    return read_files(spark, [str(p) for p in paths], **kw).orderBy(ROW_ID).drop(ROW_ID)


def check(df):
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["a", "b", "c"]
    assert rows == [(1.0, "x", float("inf")), (2.5, None, float("-inf")), (None, "q, r", 3.0)] and df.schema["a"].dataType.simpleString() == "float"


@pytest.mark.parametrize("kind", ["csv", "gz", "bz2", "xz", "zip", "member"])
def test_csv_is_cleaned(spark, tmp_path, kind):
    raw = CSV.replace("nan", "").encode()
    p = tmp_path / ("t.csv" if kind == "csv" else "t.zip" if kind == "member" else f"t.csv.{kind}")
    if kind in ("zip", "member"):
        with zipfile.ZipFile(p, "w") as z:
            z.writestr("in/t.csv", raw)
            if kind == "member":
                z.writestr("other.csv", "z\n1\n")
    else:
        p.write_bytes({"csv": lambda x: x, "gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}[kind](raw))
    check(table(spark, [f"{p}::in/t.csv" if kind == "member" else p]))


def test_archive_needs_a_name(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("a.csv", "a\n1\n")
        z.writestr("b.csv", "a\n1\n")
    with pytest.raises(Exception, match="name one as"):
        table(spark, [tmp_path / "t.zip"]).collect()


def test_parquet_member(spark, tmp_path):
    buf = io.BytesIO()
    pd.DataFrame({"a": [1, 2], "b": ["x", None]}).to_parquet(buf)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.parquet", buf.getvalue())
    assert [tuple(r) for r in table(spark, [f"{tmp_path}/t.zip::t.parquet"]).collect()] == [(1.0, "x"), (2.0, None)]


def test_other_encoding(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("a,b\n1,café\n".encode("cp1252"))
    assert table(spark, [tmp_path / "t.csv"]).first()["b"] == "café"


def test_encoding_is_told_by_bytes(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("a,b\n1,\ufffd é\n".encode())
    assert table(spark, [tmp_path / "t.csv"]).first()["b"] == "\ufffd é"
    raw = b"a,b\n1,\x80 \x93q\x94 \x81\n"
    (tmp_path / "w.csv").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("w.csv", raw)
    assert [table(spark, [tmp_path / f]).first()["b"] for f in ("w.csv", "w.zip")] == ["€ “q” \ufffd"] * 2


def test_quoted_line_breaks(spark, tmp_path):
    text = 'a,b\n1,"x\ny"\n2,"says ""hi"""\n'
    (tmp_path / "t.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", text)
    for f in ("t.csv", "t.zip"):
        assert [tuple(r) for r in table(spark, [tmp_path / f]).collect()] == [(1.0, "x\ny"), (2.0, 'says "hi"')]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
@pytest.mark.parametrize("blocks", [0, 1 << 20])
def test_row_numbers_of_folders(spark, tmp_path, kind, blocks, monkeypatch):
    from plumbline.operators import splits
    from plumbline.sources import reading

    monkeypatch.setattr(reading, "MAX_BLOCKS", blocks)
    for folder, lo in (("one", 0), ("two", 300)):
        (tmp_path / folder).mkdir()
        for k in range(3):
            f = pd.DataFrame({"a": range(lo + 100 * k, lo + 100 * k + 100), "y": ["p", "q"] * 50})
            f.to_csv(tmp_path / folder / f"part-{k}.csv", index=False) if kind == "csv" else f.to_parquet(tmp_path / folder / f"part-{k}.parquet")
    paths = [str(tmp_path / x) + ("/*.parquet" if kind == "parquet" else "") for x in ("one", "two")]
    got = read_files(spark, paths).orderBy(ROW_ID).collect()
    assert [r[ROW_ID] for r in got] == list(range(600)) and [r["a"] for r in got] == list(range(600))
    # a split of the folders is that of one file with the same rows
    pd.DataFrame({"a": range(600), "y": ["p", "q"] * 300}).to_parquet(tmp_path / "all.parquet")
    tests = [sorted(r["a"] for r in splits.stratified_split(read_files(spark, p), "y", 0.8, 3, ROW_ID)[1].collect()) for p in (paths, [str(tmp_path / "all.parquet")])]
    assert tests[0] == tests[1] and len(tests[0]) == 120


def test_row_numbers_do_not_depend_on_partitions(spark):
    from plumbline.sources import reading

    # places as 100,000 partitions would give them, in two files
    x = spark.range(200_000).selectExpr("concat('f', id div 100000) AS __file", "(id % 100000) * 134217728 AS __block", "(id % 100000) * 8589934592 AS __at", "id AS want")
    out, end = reading._numbered(x.unionByName(x.selectExpr("__file", "__block", "__at + 1 AS __at", "-1 AS want")), 10)
    assert end == 400_010 and out.where("want >= 0").selectExpr(f"count_if({ROW_ID} <> 10 + 2 * want)", f"count(distinct {ROW_ID})").first()[0] == 0 and out.select(F.countDistinct(ROW_ID)).first()[0] == 400_000


def test_files_are_aligned_to_the_first(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("b,c,a\n7,9,oops\n8,9,2\n")
    assert [tuple(r) for r in table(spark, [tmp_path / "1.csv", tmp_path / "2.csv"]).collect()] == [(1.0, "x"), (None, "7"), (2.0, "8")]


def test_names_given(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,x\n2,y\n")
    assert [tuple(r) for r in table(spark, [tmp_path / "t.csv"], column_names=["n", "s"]).collect()] == [(1.0, "x"), (2.0, "y")]
    with pytest.raises(ValueError, match="column_names has 1"):
        table(spark, [tmp_path / "t.csv"], column_names=["n"])


def test_sample_is_exact_and_does_not_depend_on_partitions(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    a = table(spark, [tmp_path / "t.parquet"], max_rows=100, seed=1)
    assert a.count() == 100 and a.select(F.countDistinct("id")).first()[0] == 100
    assert table(spark, [tmp_path / "t.parquet"], max_rows=5000).count() == 1000


def test_order_is_file_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n" + "\n".join(str(k) for k in range(5000)) + "\n")
    assert [r[0] for r in table(spark, [tmp_path / "t.csv"]).collect()] == [float(k) for k in range(5000)]
