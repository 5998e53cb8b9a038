from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import DataFrame, SparkSession

from storelens.schema import ORDERS


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


_NAMES = [f.name for f in ORDERS.fields]


def order(order_id: str = "A", **fields) -> dict:
    """An order with defaults; dates may be ISO text, money may be a number."""
    row = dict.fromkeys(_NAMES)
    row.update(order_id=order_id, quantity=1, installments=1, total=10, order_status="delivered")
    row.update(fields)
    for name in ("order_date", "delivery_date", "return_request_date"):
        if isinstance(row[name], str):
            row[name] = date.fromisoformat(row[name])
    for name in ("total", "unit_price"):
        if row[name] is not None:
            row[name] = Decimal(str(row[name]))
    if row["delivery_days"] is not None:
        row["delivery_days"] = float(row["delivery_days"])
    return row


@pytest.fixture(scope="session")
def make_orders(spark):
    def make(*rows: dict) -> DataFrame:
        return spark.createDataFrame([tuple(r[n] for n in _NAMES) for r in rows], ORDERS)

    return make


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    columns = columns or tuple(df.columns)
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def final_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()
