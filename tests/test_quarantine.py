"""Malformed lines: kept whole and apart from the rows, counted in the report."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from runfold.operators import clean, storage
from runfold.session import staging_path
from runfold.sources import files

COLUMNS = ["id", "customer_email", "amount", "date"]
GOOD = ['1,a@b.co,5,2024-01-01', '2," x, y@b.co ",6,2024-01-02', '3,,,', '4,"say \\"hi\\"",7,', '5, é ,8,"2024']
BAD = {'6,a@b.co,5,2024-01-01,EXTRA': ("extra_fields", 5, "6"), '7,c@d.co': ("missing_fields", 2, "7"),
       '8,"c@d.co,5,2024-01-01': ("unclosed_quote", 2, "8"), '9': ("missing_fields", 1, "9"),
       '10,"a, \\", b",1': ("missing_fields", 3, "10"), ',,,,,,': ("extra_fields", 7, None),
       '11,"' + "q" * 200000 + '",' * 3000: ("unclosed_quote", None, "11")}


def write(folder, lines, header=True, name="a.csv"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(([",".join(COLUMNS)] if header else []) + lines) + "\n\n")
    return str(folder)


@pytest.mark.parametrize("header", [True, False])
def test_rows_and_quarantine_by_hand(spark, tmp_path, header):
    src = write(tmp_path / "s", GOOD + list(BAD), header)
    rows, bad = files.csv_scan_checked(spark, src, COLUMNS, header)
    assert [r.id for r in rows.orderBy(F.col("id").cast("int")).collect()] == ["1", "2", "3", "4", "5"]
    assert rows.where("id = 2").first().customer_email == " x, y@b.co " and rows.where("id = 3").first().amount is None
    got = {r.line: r for r in bad.collect()}
    assert set(got) == set(BAD)
    for line, (reason, n, first) in BAD.items():
        r = got[line]
        assert (r.reason, r.fields.id) == (reason, first) and r.file.endswith("a.csv"), line[:40]
        assert n is None or r.n_fields == n, line[:40]
    # a count or one column alone must not bring malformed lines back
    assert rows.count() == 5 and rows.select("id").count() == 5 and bad.count() == len(BAD)


def test_headers_that_differ_raise(spark, tmp_path):
    src = write(tmp_path / "s", ["1,2,3,4"], header=False)
    (tmp_path / "s" / "b.csv").write_text("id,amount,customer_email,date\n1,2,3,4\n")
    with pytest.raises(Exception, match="header"):
        files.csv_scan_checked(spark, src, COLUMNS)[0].collect()
    with pytest.raises(ValueError):
        files.csv_scan_checked(spark, src, ["id", files.RAW_LINE])


def test_load_keeps_every_line(spark, tmp_path):
    src = write(tmp_path / "s", GOOD + list(BAD))
    dst, bad = str(tmp_path / "t"), str(tmp_path / "q")
    n = clean.csv_to_parquet(spark, src, dst, COLUMNS, date="date", quarantine=bad).count()
    assert (n, spark.read.parquet(bad).count()) == (len(GOOD), len(BAD))
    seen = Observation()
    files.csv_scan_checked(spark, src, COLUMNS, observation=seen)[0].write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_malformed": len(BAD)}
    # a load without malformed lines leaves an empty, readable quarantine
    clean.csv_to_parquet(spark, write(tmp_path / "fine", GOOD), dst, COLUMNS, quarantine=bad)
    assert spark.read.parquet(bad).count() == 0 and spark.read.parquet(bad).columns == ["file", "line", "n_fields", "reason", "fields"]


def test_report_joins_lines_and_outputs(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", True, 2.0), ("b", True, 3.0), ("d", True, 4.0)] + [("e", True, 1.0)] * 20,
                                 "ds string, email_valid boolean, amount double")
    lines = spark.createDataFrame([("a",), (None,), (None,), ("e",)], "ds string")
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "ds string")
    listing = spark.createDataFrame([("a/1", 5), ("b/1", 0), ("b/2", 0), ("e/1", 9), ("z/1", 9)], "path string, length long")
    outputs = storage.output_existence(expected, listing, F.split("path", "/")[0], "ds")
    got = {r.ds: r for r in clean.validation_report(rows, "ds", quarantined=lines, outputs=outputs).collect()}
    assert {k: (r.n_rows, r.n_quarantined, r.output_status, r.issues, r.status) for k, r in got.items()} == {
        "a": (2, 1, "ok", 1, "FAILED"), "b": (1, 0, "empty", 1, "FAILED"), "c": (0, 0, "missing", 1, "FAILED"),
        "d": (1, 0, None, 0, "PASSED"), "e": (20, 1, "ok", 1, "WARNING"), None: (0, 2, None, 2, "FAILED")}
    assert got["b"].remedy == "load again, output is empty" and got["c"].remedy == "load again, output is missing"
    assert got["a"].remedy == "repair malformed lines in quarantine" and got["d"].remedy == "none"
    plain = clean.validation_report(rows, "ds")
    assert "n_quarantined" not in plain.columns and plain.count() == 4


def test_empty_folder_of_lines(spark):
    src = staging_path(spark, "no-lines")
    spark.createDataFrame([], "value string").write.text(src)
    rows, bad = files.csv_scan_checked(spark, src, COLUMNS, header=False)
    assert rows.count() == 0 and bad.count() == 0 and rows.columns == COLUMNS
