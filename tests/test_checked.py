"""Cells and lines that do not parse."""

import datetime as dt
import json

import pytest
from pyspark.sql import types as T

from wardline.sources.checked import read_checked, split_checked

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("n", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("day", T.DateType()),
    ]
)
HEAD = "id,at,n,x,ok,day\n"
GOOD = "2024-01-03 10:00:00,5,1.5,true,2024-01-03"


def rejected(df):
    return {r["id"]: [(e["cell"], e["value"]) for e in r["rejected"]] for r in df.collect()}


def test_every_kind_of_bad_cell(spark, tmp_path):
    lines = [
        "a," + GOOD,
        "b,,,,,",
        "c,soon,5,1.5,true,2024-01-03",
        "d,2024-01-03 10:00:00,12.5,1.5,true,2024-01-03",
        'e,2024-01-03 10:00:00,5,"1,5",true,2024-01-03',
        "f,2024-01-03 10:00:00,5,1.5,maybe,2024-01-03",
        "g,2024-01-03 10:00:00,5,1.5,true,2024-02-30",
        "h,soon,99999999999999999999,1.5,true,2024-01-03",
        "a," + GOOD,
    ]
    (tmp_path / "t.csv").write_text(HEAD + "\n".join(lines) + "\n")
    done = split_checked(read_checked(spark, str(tmp_path / "t.csv"), SCHEMA), str(tmp_path / "out"))
    assert (done.n_sound, done.n_rejected) == (3, 6)
    assert rejected(done.rejected) == {
        "c": [("at", "soon")],
        "d": [("n", "12.5")],
        "e": [("x", "1,5")],
        "f": [("ok", "maybe")],
        "g": [("day", "2024-02-30")],
        "h": [("at", "soon"), ("n", "99999999999999999999")],
    }
    sound = sorted(map(tuple, done.sound.collect()))
    good = ("a", dt.datetime(2024, 1, 3, 10), 5, 1.5, True, dt.date(2024, 1, 3))
    assert sound == [good, good, ("b", None, None, None, None, None)]
    # what parsed in a row with a rejected cell stays
    assert done.rejected.where("id = 'c'").first()["n"] == 5


def test_lines_with_other_numbers_of_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEAD + "a," + GOOD + "\nshort,5\nlong," + GOOD + ",more\n")
    done = split_checked(read_checked(spark, str(tmp_path / "t.csv"), SCHEMA), str(tmp_path / "out"))
    assert (done.n_sound, done.n_rejected) == (1, 2)
    rows = done.rejected.collect()
    assert sorted(r["rejected"][0]["value"] for r in rows) == ["long," + GOOD + ",more", "short,5"]
    assert all(len(r["rejected"]) == 1 and r["rejected"][0]["cell"] is None and r["id"] is None for r in rows)


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"id": "a", "n": 5, "x": 1.5, "ok": True}), json.dumps({"id": "b", "n": "many"}), '{"id": "c", ']
    (tmp_path / "t.json").write_text("\n".join(lines) + "\n")
    done = split_checked(read_checked(spark, str(tmp_path / "t.json"), SCHEMA, "json"), str(tmp_path / "out"))
    assert (done.n_sound, done.n_rejected) == (1, 2)
    assert rejected(done.rejected) == {"b": [("n", "many")], None: [(None, '{"id": "c", ')]}


def test_empty_table_and_wrong_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEAD)
    done = split_checked(read_checked(spark, str(tmp_path / "t.csv"), SCHEMA), str(tmp_path / "out"))
    assert done[2:] == (0, 0) and done.sound.count() == done.rejected.count() == 0
    (tmp_path / "u.csv").write_text("id,n,at,x,ok,day\na," + GOOD + "\n")
    with pytest.raises(Exception, match="header"):
        read_checked(spark, str(tmp_path / "u.csv"), SCHEMA).collect()


def test_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="typed"):
        read_checked(spark, str(tmp_path), SCHEMA, "parquet")
    with pytest.raises(ValueError, match="rejected"):
        read_checked(spark, str(tmp_path), T.StructType([T.StructField("Rejected", T.LongType())]))
