"""The public functions by name, with the aliases external clients know.

Each takes DataFrames and plain parameters and returns one DataFrame, or a dict of
them where one answer has several tables. An empty period gives empty or zero tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame

from storelens.operators import charts, order_desk, returns, sales, vectors, weekly

Period = date | str | None


def search_policies(chunks: DataFrame, query: str, encoder: vectors.Encoder, k: int = 5) -> DataFrame:
    return vectors.search_policies(chunks, query, encoder, k)


def sales_overview(orders: DataFrame, start_date: Period = None, end_date: Period = None) -> dict[str, DataFrame]:
    return {
        "overview": sales.sales_overview(orders, start_date, end_date),
        "by_status": sales.orders_by_status_counts(orders, start_date, end_date),
    }


def returns_report(orders: DataFrame, start_date: Period = None, end_date: Period = None) -> dict[str, DataFrame]:
    return {
        "totals": returns.returns_report(orders, start_date, end_date),
        "reasons": returns.return_reasons(orders, start_date, end_date),
        "statuses": returns.return_status_counts(orders, start_date, end_date),
    }


def generate_chart(
    orders: DataFrame,
    kind: str,
    lang: str = "en",
    n: int = 10,
    start_date: Period = None,
    end_date: Period = None,
) -> dict[str, DataFrame]:
    return {
        "series": charts.chart_series(orders, kind, lang, n, start_date, end_date),
        "summary": charts.chart_summary(orders, kind, lang, n, start_date, end_date),
    }


def best_sellers(orders: DataFrame, n: int = 5, by: str = "revenue") -> DataFrame:
    return sales.top_products(orders, n, by)


def chart(orders: DataFrame, kind: str, lang: str = "en", n: int = 10) -> dict[str, DataFrame]:
    return generate_chart(orders, kind, lang, n)


FUNCTIONS: dict[str, Callable] = {
    "search_policies": search_policies,
    "sales_overview": sales_overview,
    "top_products": sales.top_products,
    "sales_breakdown": sales.sales_breakdown,
    "returns_report": returns_report,
    "late_return_requests": returns.late_return_requests,
    "order_lookup": order_desk.order_lookup,
    "list_orders": order_desk.list_orders,
    "report_summary": weekly.report_summary,
    "generate_chart": generate_chart,
}

ALIASES: dict[str, Callable] = {
    "policy_search": search_policies,
    "sales_summary": sales_overview,
    "best_sellers": best_sellers,
    "sales_by": sales.sales_breakdown,
    "returns_summary": returns_report,
    "returns_outside_window": returns.late_return_requests,
    "order_details": order_desk.order_lookup,
    "orders_by_status": order_desk.list_orders,
    "weekly_report_figures": weekly.report_summary,
    "chart": chart,
}


def call(name: str, *args, **kwargs) -> DataFrame | dict[str, DataFrame]:
    """Run a public function by its name or alias."""
    function = FUNCTIONS.get(name) or ALIASES.get(name)
    if function is None:
        raise ValueError(f"unknown function {name!r}, use one of: {', '.join([*FUNCTIONS, *ALIASES])}")
    return function(*args, **kwargs)
