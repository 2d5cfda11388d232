import pytest

from lexweave.functions.similarity import similarity
from lexweave.operators import assemble
from lexweave.sources import tables
from lexweave.streaming.stateless import best_match_stream, clean_stream, match_stream


def test_csv_round_trip(spark, tmp_path):
    src = tmp_path / "a.csv"
    src.write_text('﻿id,name\n1,NA\n2,\n3,"x, ""y"""\n', encoding="utf-8")
    df = tables.read_csv(spark, str(src))
    assert [tuple(r) for r in df.collect()] == [("1", "NA"), ("2", ""), ("3", 'x, "y"')]
    tables.write_csv(df, str(tmp_path / "out"), single_file=True)
    assert sorted(tables.read_csv(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())
    tables.write_csv(df, str(tmp_path / "b.csv"), bom=True)
    assert (tmp_path / "b.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_small_sources(spark, tmp_path):
    assert [r[0] for r in tables.text_lines(spark, [" a ", "", "\ta\t", "\t", "\u3000b\x1f"]).collect()] == ["a", "a", "b"]
    assert [tuple(r) for r in tables.items(spark, {"x": 1, "y": 2}).collect()] == [(0, "x"), (1, "y")]
    cases = tmp_path / "t.csv"
    cases.write_text("left,right,expected\na,a,\tYes\na,b,no\n")
    rows = assemble.evaluated(tables.test_cases(spark, str(cases)), similarity("EXACT", "left", "right")["success"])
    assert assemble.evaluation_totals(rows).first().asDict() == {"total": 2, "passed": 2, "failed": 0}
    report = tmp_path / "r.csv"
    report.write_text("df1_idx,df2_idx,final_result,debug\n1,2,True,x\n")
    assert tuple(tables.report_pairs(spark, str(report)).first()) == (1, 2, True)
    with pytest.raises(ValueError):
        tables.dataset(spark, str(cases), str(report), {}, (["left"], ["none"]))
    one, two = tables.items(spark, ["a", "b"]), tables.items(spark, ["c"]).withColumnsRenamed({"index": "i", "data": "d"})
    assert tables.nested_loop(one, two).count() == 2


def test_workbook_is_never_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LOCAL_ROWS", 3)
    monkeypatch.setattr(tables, "_workbooks", lambda: None)
    with pytest.raises(ValueError, match="more than 3 rows"):
        tables.write_workbook(spark.range(4), str(tmp_path / "a.xlsx"))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("Hello",), ("Helo",)], "t string").write.parquet(str(src))
    stream = spark.readStream.schema("t string").parquet(str(src))
    refs = spark.createDataFrame([("hello",)], "ref string")

    def rows(df, name):
        q = df.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return sorted(tuple(r) for r in spark.table(name).collect())

    assert rows(clean_stream(stream, "t", ["StrFunc_Lowercase"]), "cleaned") == [("Hello", "hello"), ("Helo", "helo")]
    assert rows(match_stream(clean_stream(stream, "t", ["StrFunc_Lowercase"]), refs, "Levenshtein", "result", "ref", 0.9), "matched") == [("Hello", "hello", "hello")]
    found = []
    q = best_match_stream(stream, refs, lambda df, n: found.extend(df.collect()), checkpoint=str(tmp_path / "cp"), strategy="Levenshtein", threshold=0.5, left_col="t", right_col="ref")
    q.processAllAvailable()
    q.stop()
    assert sorted(r["query"] for r in found) == ["Hello", "Helo"]


def test_compressed_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, True, 'a "q", b\nc'), (3, 4, True, "")], "df1_idx long, df2_idx long, final_result boolean, debug string")
    tables.write_csv(df, str(tmp_path / "out"), compression="lz4")
    assert all(p.name.endswith(".csv.lz4") for p in (tmp_path / "out").glob("part-*"))
    assert sorted(tuple(r) for r in tables.report_pairs(spark, str(tmp_path / "out")).collect()) == [(1, 2, True), (3, 4, True)]
    assert sorted(r["debug"] for r in tables.read_csv(spark, str(tmp_path / "out")).collect()) == ["", 'a "q", b\nc']
