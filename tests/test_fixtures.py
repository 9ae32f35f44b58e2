"""The three inline CSV fixtures, end to end."""

from decimal import Decimal

from pyspark.sql import functions as F

from runfold.operators import clean, storage
from runfold.sources import files

SALES = """id,customer_email,amount,date
1, Ahmed.Kamal@Example.com ,150.50,2024-01-01
2, JANE.DOE@test.org , 200.00,2024-01-02
3, invalid-email, 50.00,2024-01-03
4, bob.smith@work.com, 75.25,2024-01-04
"""
PRODUCTS = """id,product,price
1,Alpha-Widget,15.50
2,Beta-Gizmo,20.00
3,Gamma-Tool,14.50
"""
SAMPLE = """id,amount,customer_email
1,250.00,user@domain.com
"""


def _write(tmp_path, name, text):
    d = tmp_path / name
    d.mkdir()
    (d / "part.csv").write_text(text)
    return str(d)


def test_sales_clean_to_parquet(spark, tmp_path):
    src = _write(tmp_path, "raw", SALES)
    out = clean.csv_to_parquet(spark, src, str(tmp_path / "cleaned"), ["id", "customer_email", "amount", "date"],
                               date="date", casts={"id": "int"})
    rows = {r["id"]: r for r in out.collect()}
    assert [rows[i]["customer_email"] for i in (1, 2, 3, 4)] == [
        "ahmed.kamal@example.com", "jane.doe@test.org", None, "bob.smith@work.com"]
    assert [rows[i]["email_valid"] for i in (1, 2, 3, 4)] == [True, True, False, True]
    assert [rows[i]["amount"] for i in (1, 2, 3, 4)] == [Decimal("150.50"), Decimal("200.00"),
                                                         Decimal("50.00"), Decimal("75.25")]
    assert str(rows[4]["date"]) == "2024-01-04"
    assert clean.column_total(out, "amount").first()["total"] == Decimal("475.75")


def test_typed_csv_read_loses_padded_money(spark, tmp_path):
    """Trap T1: a DECIMAL schema silently gives NULL for ' 200.00'."""
    src = _write(tmp_path, "raw", SALES)
    df = files.csv_scan(spark, src, schema="id INT, customer_email STRING, amount DECIMAL(18,2), date STRING")
    assert df.where(F.col("amount").isNull()).count() == 3
    text = files.csv_scan(spark, src, columns=["id", "customer_email", "amount", "date"])
    assert text.where(F.col("amount") == " 200.00").count() == 1


def test_products_total_is_exactly_50(spark, tmp_path):
    src = _write(tmp_path, "raw", PRODUCTS)
    df = clean.clean_amount_date(files.csv_scan(spark, src, columns=["id", "product", "price"]), "price", None)
    assert clean.column_total(df, "price").first()["total"] == Decimal("50.00")


def test_sample_sales(spark, tmp_path):
    src = _write(tmp_path, "raw", SAMPLE)
    df = clean.clean_email(files.csv_scan(spark, src, columns=["id", "amount", "customer_email"]))
    r = df.first()
    assert r["customer_email"] == "user@domain.com" and r["email_valid"]


def test_empty_cleaned_prefix_reported_missing(spark, tmp_path):
    root = tmp_path / "bucket"
    (root / "raw").mkdir(parents=True)
    (root / "raw" / "products.csv").write_text(PRODUCTS)
    (root / "cleaned").mkdir()
    listing = files.object_listing(spark, str(root))
    expected = spark.createDataFrame([("raw",), ("cleaned",)], "prefix string")
    prefix = storage.relative_prefix(F.regexp_replace("path", "^file:(//)?", ""), str(root))
    rep = {r["prefix"]: r for r in storage.output_existence(expected, listing, prefix).collect()}
    assert rep["raw"]["status"] == "ok" and rep["cleaned"]["status"] == "missing"
    assert not rep["cleaned"]["passed"]
