from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from storelens.functions.columns import (
    localized,
    mixed_date,
    money,
    money_text,
    number,
    percent_text,
    pretty,
    strip,
    whole_number,
)
from storelens.lookups import LABELS_ES
from storelens.schema import ORDERS
from storelens.sources.orders import clean_orders, read_orders, read_orders_with_fallback, write_orders
from storelens.sources.warehouse import order_id
from tests.conftest import rows


def column(spark, values, build):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(build("c")).collect()]


def test_money(spark):
    raw = ["$39.99", "$1,234.50", " 5 ", "1e3", "39.999", "abc", "(5)", "", None, "nan", "inf", "-3.5"]
    clean = [D("39.99"), D("1234.50"), D("5.00"), D("1000.00"), D("40.00")] + [None] * 6 + [D("-3.50")]
    assert column(spark, raw, money) == clean


def test_mixed_dates(spark):
    cases = {
        "2026-07-20": date(2026, 7, 20),
        "2026-07-20 13:45:00": date(2026, 7, 20),
        "2026-07-20T23:59:59": date(2026, 7, 20),
        "7/4/2026": date(2026, 7, 4),
        "03/04/2026": date(2026, 3, 4),
        "7/4/2026 10:30": date(2026, 7, 4),
        "25/12/2025": date(2025, 12, 25),
        "2026/07/05": date(2026, 7, 5),
        "July 4, 2026": date(2026, 7, 4),
        "Jul 4, 2026": date(2026, 7, 4),
        "4 July 2026": date(2026, 7, 4),
        "7/4/26": date(2026, 7, 4),
        "20260720": date(2026, 7, 20),
        "May 4, 2026": date(2026, 5, 4),
        "4 May 2026": date(2026, 5, 4),
        "4-Jul-2026": date(2026, 7, 4),
        "July 4 2026": date(2026, 7, 4),
        "13-07-2026": date(2026, 7, 13),
        "04-07-2026": date(2026, 4, 7),
        "2026-7-4": date(2026, 7, 4),
        " 7/4/2026 ": date(2026, 7, 4),
        "31/31/2026": None,
        "2026-13-01": None,
        "": None,
        "n/a": None,
        "12:30": None,
        None: None,
    }
    assert column(spark, list(cases), mixed_date) == list(cases.values())


def test_strict_dates_fail_on_text_but_not_on_missing(spark):
    assert column(spark, ["2026-07-20", "", None], lambda c: mixed_date(c, strict=True)) == [
        date(2026, 7, 20), None, None,
    ]
    with pytest.raises(PySparkException, match="unreadable date: soon"):
        column(spark, ["soon"], lambda c: mixed_date(c, strict=True))


def test_numbers(spark):
    assert column(spark, ["3", "3.0", "", "x", "nan", None], number) == [3.0, 3.0, None, None, None, None]
    assert column(spark, ["3", "3.0", "", "x"], whole_number) == [3, 3, None, None]


def test_labels(spark):
    assert column(spark, ["Home", "Garden", None], lambda c: localized(c, LABELS_ES)) == ["Hogar", "Garden", None]
    assert column(spark, ["Home"], lambda c: localized(c, {})) == ["Home"]
    assert column(spark, ["cash_on_delivery", "wrong_size_or_Model", "", None], pretty) == [
        "Cash on delivery", "Wrong size or model", "", None,
    ]


def test_report_text(spark):
    df = spark.createDataFrame([(1234.5,), (0.5,), (1e6,), (None,)], "c double")
    assert rows(df.select(money_text("c"), money_text("c", 2), percent_text("c"))) == [
        ("$1,234", "$1,234.50", "1,234.5%"), ("$0", "$0.50", "0.5%"), ("$1,000,000", "$1,000,000.00", "1,000,000.0%"),
        (None, None, None),
    ]


def test_strip_takes_all_whitespace(spark):
    assert column(spark, ["\n\t a b \r\n", " x "], strip) == ["a b", "x"]


HEADER = "total,order_id,order_date,product,country,order_status,delivery_days,return_request_date,return_reason\n"


@pytest.fixture
def sheet(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        HEADER
        + '"$1,234.50",A,7/4/2026,"Lamp ""XL"", red",Chile,delivered,3,whenever,\n'
        + "$39.99,B,2026-07-20,Chair,,,,2026-07-25,changed_mind\n"
        + "abc,C,25/12/2025,Desk,N/A,cancelled,n/a,,\n",
        encoding="utf-8",
    )
    return str(path)


def test_read_and_clean_by_name(spark, sheet):
    clean = clean_orders(read_orders(spark, sheet))
    assert [(f.name, f.dataType) for f in clean.schema] == [(f.name, f.dataType) for f in ORDERS]
    got = rows(
        clean.orderBy("order_id"),
        "order_id", "order_date", "product", "total", "country", "order_status", "delivery_days",
        "return_request_date", "return_reason", "quantity",
    )
    assert got == [
        ("A", date(2026, 7, 4), 'Lamp "XL", red', D("1234.50"), "Chile", "delivered", 3.0, None, None, None),
        ("B", date(2026, 7, 20), "Chair", D("39.99"), None, None, None, date(2026, 7, 25), "changed_mind", None),
        ("C", date(2025, 12, 25), "Desk", None, None, "cancelled", None, None, None, None),
    ]


def test_missing_required_column(spark):
    with pytest.raises(ValueError, match="total"):
        clean_orders(spark.createDataFrame([("A", "2026-01-01")], "order_id string, order_date string"))


def test_fallback(spark, sheet, tmp_path):
    malformed = tmp_path / "other.csv"
    malformed.write_text("a,b\n1,2\n")
    for primary in (None, "", str(tmp_path / "absent.csv"), str(malformed)):
        assert read_orders_with_fallback(spark, primary, sheet).count() == 3
    good = tmp_path / "live.csv"
    good.write_text("order_id,order_date,total\nZ,2026-01-01,5\n")
    assert rows(read_orders_with_fallback(spark, str(good), sheet), "order_id") == [("Z",)]


def test_a_store_that_cannot_be_reached_falls_back(spark, sheet):
    for primary in ("nosuchscheme://bucket/orders.csv", "s3a://bucket/orders.csv"):
        assert read_orders_with_fallback(spark, primary, sheet).count() == 3


def test_a_line_break_in_a_cell_makes_no_order(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text('order_id,order_date,total,product\nA,2026-01-01,5,"two\nlines"\nB,2026-01-02,6,x\n')
    assert sorted(rows(read_orders(spark, str(path)), "order_id", "product")) == [("A", "two\nlines"), ("B", "x")]


def test_long_order_ids_stay_whole(spark):
    keys = [7, 999_999_999, 1_234_567_890, 12_345_678_901]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(order_id(F.col("k"))).collect()
    assert [r[0] for r in got] == ["ORD-000000007", "ORD-999999999", "ORD-1234567890", "ORD-12345678901"]


# Texts that sheets export, and the day pandas reads in them.
EXPORTED = {
    "7/20/2026 1:45 PM": (2026, 7, 20), "2026-07-20 1:45 PM": (2026, 7, 20), "20-Jul-26": (2026, 7, 20), "Mon, 20 Jul 2026": (2026, 7, 20),
    "Monday, July 20, 2026": (2026, 7, 20), "2026.07.20": (2026, 7, 20), "20.07.2026": (2026, 7, 20), "07.05.2026": (2026, 7, 5),
    "Sept 5, 2026": (2026, 9, 5), "Jul 20, 2026 14:00": (2026, 7, 20), "Jul 2026": (2026, 7, 1), "2026": (2026, 1, 1),
}


@pytest.mark.parametrize("strict", [False, True])
def test_dates_that_sheets_export(spark, strict):
    df = spark.createDataFrame([(t,) for t in EXPORTED], "t string")
    assert [r[0] for r in df.select(mixed_date("t", strict=strict)).collect()] == [date(*d) for d in EXPORTED.values()]


def test_stored_orders_push_the_period_down(spark, sheet, tmp_path):
    write_orders(clean_orders(read_orders(spark, sheet)), str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    wanted = stored.where(F.col("order_date") >= date(2026, 1, 1)).select("total")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date,2026-01-01)" in plan
    assert "ReadSchema: struct<order_date:date,total:decimal(18,2)>" in plan
    assert wanted.count() == 2


def test_timestamps_clean_to_dates(spark):
    raw = spark.createDataFrame(
        [("A", datetime(2026, 7, 20, 23, 59), 5.0)], "order_id string, order_date timestamp_ntz, total double"
    )
    assert rows(clean_orders(raw), "order_date", "total") == [(date(2026, 7, 20), D("5.00"))]


def test_any_date_column_can_be_strict(spark):
    raw = spark.createDataFrame(
        [("A", "2026-07-20", 5.0, "soon")], "order_id string, order_date string, total double, delivery_date string"
    )
    assert rows(clean_orders(raw), "delivery_date") == [(None,)]
    strict = clean_orders(raw, strict_dates=("order_date", "delivery_date"))
    with pytest.raises(PySparkException, match="unreadable date: soon"):
        strict.select("delivery_date").collect()
