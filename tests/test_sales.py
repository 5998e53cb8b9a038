from datetime import date
from decimal import Decimal as D

import pytest

from storelens import ALIASES, FUNCTIONS, call
from storelens.operators import order_desk, returns, sales
from tests.conftest import order, rows


@pytest.fixture(scope="module")
def orders(make_orders):
    return make_orders(
        order("A1", order_date="2026-01-05", product="Lamp", category="Home", total=30, quantity=1, country="Chile"),
        order("A2", order_date="2026-01-31", product="Desk", category="Home", total=50, quantity=2, country="Peru"),
        order("A3", order_date="2026-02-01", product="Chair", category="Home", total=50, quantity=5, country=None),
        order("A4", order_date="2026-02-10", product="Lamp", category="Home", total=99, quantity=9,
              country="Chile", order_status="cancelled"),
        order("A5", order_date="2026-02-11", product="Lamp", category="Home", total=None, quantity=1,
              country="Chile", order_status=None),
        order("A6", order_date=None, product="Sofa", category=None, total=7, country="Peru", order_status="shipped"),
    )


def test_period_bounds_are_inclusive_and_optional(orders):
    ids = lambda df: sorted(r[0] for r in rows(df, "order_id"))
    assert ids(sales.in_period(orders)) == ["A1", "A2", "A3", "A4", "A5", "A6"]
    assert ids(sales.in_period(orders, "", "2026-01-31")) == ["A1", "A2"]
    assert ids(sales.in_period(orders, date(2026, 1, 31), "2026-02-10")) == ["A2", "A3", "A4"]
    with pytest.raises(ValueError):
        sales.in_period(orders, "yesterday")


def test_missing_status_is_not_cancelled(orders):
    assert sorted(r[0] for r in rows(sales.non_cancelled(orders), "order_id")) == ["A1", "A2", "A3", "A5", "A6"]


def test_overview(orders):
    assert rows(sales.sales_overview(orders)) == [(date(2026, 1, 5), date(2026, 2, 11), D("137.00"), 5, 34.25)]
    assert rows(sales.sales_overview(orders, "2027-01-01")) == [(None, None, D("0.00"), 0, None)]


def test_status_counts(orders):
    assert rows(sales.orders_by_status_counts(orders)) == [("delivered", 3), ("cancelled", 1), ("shipped", 1)]


def test_top_products(orders):
    assert rows(sales.top_products(orders, 2)) == [
        (1, "Chair", "Home", D("50.00")), (2, "Desk", "Home", D("50.00")),
    ]
    assert rows(sales.top_products(orders, 5, by="units")) == [
        (1, "Chair", "Home", 5), (2, "Desk", "Home", 2), (3, "Lamp", "Home", 2),
    ]
    assert sales.top_products(orders, by="anything").columns[-1] == "revenue"
    assert rows(sales.top_products(orders, start_date="2030-01-01")) == []


def test_breakdown(orders):
    assert rows(sales.sales_breakdown(orders, "month")) == [
        ("2026-01", D("80.00"), 2), ("2026-02", D("50.00"), 2),
    ]
    assert rows(sales.sales_breakdown(orders, "country")) == [("Peru", D("57.00"), 2), ("Chile", D("30.00"), 2)]
    with pytest.raises(ValueError, match="dimension"):
        sales.sales_breakdown(orders, "product")


def test_order_lookup(orders):
    assert rows(order_desk.order_lookup(orders, " a2 "), "order_id", "product") == [("A2", "Desk")]
    assert rows(order_desk.order_lookup(orders, "A99")) == []


def test_repeated_id_gives_the_earliest(make_orders):
    twice = make_orders(order("X", order_date="2026-03-02"), order("X", order_date="2026-03-01"))
    assert rows(order_desk.order_lookup(twice, "x"), "order_date") == [(date(2026, 3, 1),)]


def test_list_orders(orders):
    got = rows(order_desk.list_orders(orders, " Delivered", country="CHILE"))
    assert got == [("A1", date(2026, 1, 5), "Chile", "Lamp", D("30.00"), 37, 3, 1)]
    assert [r[0] for r in rows(order_desk.list_orders(orders, "delivered", limit=2))] == ["A3", "A2"]
    assert rows(order_desk.list_orders(orders, "lost")) == []


def test_list_is_capped_at_fifty_newest_first(make_orders):
    many = make_orders(*[order(f"B{i:03d}", order_date=f"2026-01-{1 + i % 28:02d}") for i in range(80)])
    got = rows(order_desk.list_orders(many, "delivered", limit=1000), "order_id", "order_date", "status_total")
    assert len(got) == 50 and got[0][2] == 80
    assert got == sorted(got, key=lambda r: (-r[1].toordinal(), r[0]))


@pytest.fixture(scope="module")
def returned(make_orders):
    def back(i, delivered, asked, reason, status, **more):
        return order(i, order_date="2026-01-01", delivery_date=delivered, return_request_date=asked,
                     return_reason=reason, return_status=status, **more)

    return make_orders(
        back("R1", "2026-01-05", "2026-01-15", "changed_mind", "approved"),
        back("R2", "2026-01-05", "2026-01-16", "changed_mind", "pending"),
        back("R3", "2026-01-05", "2026-01-20", None, "pending"),
        back("R4", None, "2026-03-01", "odd", None, order_status="shipped"),
        order("R5", order_date="2026-01-01", delivery_date="2026-01-04"),
        order("R6", order_date="2026-02-01"),
    )


def test_returns_report(returned):
    assert rows(returns.returns_report(returned)) == [(4, 5, 0.8)]
    assert rows(returns.returns_report(returned, end_date="2025-01-01")) == [(0, 0, None)]
    assert rows(returns.return_reasons(returned)) == [("changed_mind", 2), ("odd", 1)]
    assert rows(returns.return_reasons(returned, n=1)) == [("changed_mind", 2)]
    assert rows(returns.return_status_counts(returned)) == [("pending", 2), ("approved", 1)]


def test_late_returns(returned, make_orders):
    # Ten days after delivery is still in time; without a delivery a request is never late.
    assert rows(returns.late_return_requests(returned, 10)) == [(4, 2, 0.5, 13.0)]
    assert rows(returns.late_return_requests(returned, 100)) == [(4, 0, 0.0, None)]
    assert rows(returns.late_return_requests(make_orders(order("N")), 10)) == [(0, 0, None, None)]


def test_public_names(orders):
    assert len(FUNCTIONS) == len(ALIASES) == 10
    assert rows(call("best_sellers", orders, n=1)) == rows(call("top_products", orders, n=1))
    assert set(call("sales_summary", orders)) == {"overview", "by_status"}
    assert rows(call("returns_summary", orders)["totals"]) == [(0, 3, 0.0)]
    assert rows(call("order_details", orders, "A1"), "order_id") == [("A1",)]
    with pytest.raises(ValueError, match="unknown function"):
        call("drop_orders", orders)
