"""Type inference of CSV scans: the narrowest type that holds all values, missing marks, unusual names and texts."""

import math

from tessera.sources.io import infer_types, read_csv_inferred, read_csv_strings


def written(tmp_path, text):
    path = tmp_path / "table.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_types_and_values(spark, tmp_path):
    path = written(tmp_path, 'key,whole,gaps,real,large,flag,flag gaps,text,a.b,none\n'
                             '1,-7,4,1.5,9223372036854775807,True,true,"say ""x"", yes",1e3,NA\n'
                             '2,+8,NaN,-.5,9223372036854775808,FALSE,,1x,inf,\n'
                             '3, 9 ,5,2.,0,false,False,N/A,-2,null\n')
    types = {r["column_name"]: r["type"] for r in infer_types(read_csv_strings(spark, path)).collect()}
    assert types == {"key": "bigint", "whole": "bigint", "gaps": "double", "real": "double", "large": "double", "flag": "boolean", "flag gaps": "string",
                     "text": "string", "a.b": "double", "none": "double"}
    rows = read_csv_inferred(spark, path).orderBy("key").collect()
    assert [r["whole"] for r in rows] == [-7, 8, 9] and [r["gaps"] for r in rows] == [4.0, None, 5.0] and [r["real"] for r in rows] == [1.5, -0.5, 2.0]
    assert [r["flag"] for r in rows] == [True, False, False] and [r["flag gaps"] for r in rows] == ["true", None, "False"]
    assert [r["text"] for r in rows] == ['say "x", yes', "1x", None] and [r["a.b"] for r in rows] == [1000.0, math.inf, -2.0]
    assert rows[0]["large"] == 2.0 ** 63 and [r["none"] for r in rows] == [None, None, None]


def test_texts_that_a_cast_would_take_stay_texts(spark, tmp_path):
    path = written(tmp_path, "suffix,spaced\n1d,1 2\n2f,3\n")
    assert [r["type"] for r in infer_types(read_csv_strings(spark, path)).orderBy("place").collect()] == ["string", "string"]
    assert [r["suffix"] for r in read_csv_inferred(spark, path).collect()] == ["1d", "2f"]


def test_own_marks_and_no_rows(spark, tmp_path):
    path = written(tmp_path, "a,n_rows\n1,x\n-,y\n")
    found = {r["column_name"]: r for r in infer_types(read_csv_strings(spark, path), ("-",)).collect()}
    assert found["a"]["type"] == "double" and found["a"]["n_missing"] == 1 and found["n_rows"]["type"] == "string"
    empty = spark.createDataFrame([], "a string, b string")
    assert [(r["n_rows"], r["n_missing"], r["type"]) for r in infer_types(empty).collect()] == [(0, 0, "string")] * 2
