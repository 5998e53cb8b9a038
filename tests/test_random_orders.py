"""Sales, returns and charts on random dirty orders against plain Python."""

from collections import Counter, defaultdict
from decimal import Decimal as D
from statistics import mean, median

import pytest

from storelens.operators import order_desk, returns, sales
from storelens.operators.charts import chart_series, chart_summary
from tests.conftest import rows
from tests.test_weekly import DAY, random_orders

PERIODS = [(None, None), ("2026-01-15", None), ("2026-01-10", "2026-02-20"), ("2031-01-01", None)]


@pytest.fixture(scope="module", params=[11, 12])
def case(request, make_orders):
    made = random_orders(request.param, 220)
    for i, o in enumerate(made):
        if o["return_request_date"] and i % 3:
            o["delivery_date"] = o["return_request_date"] - DAY * (i % 17)
    df = make_orders(*made).persist()
    yield made, df
    df.unpersist()


def inside(made, start, end):
    iso = lambda o: o["order_date"].isoformat() if o["order_date"] else None
    return [o for o in made if (not start or (iso(o) and iso(o) >= start)) and (not end or (iso(o) and iso(o) <= end))]


def money(group):
    return sum((o["total"] or D(0) for o in group), D("0.00")).quantize(D("0.01"))


def kept(made):
    return [o for o in made if o["order_status"] != "cancelled"]


def groups(made, *keys):
    out = defaultdict(list)
    for o in made:
        if all(o[k] is not None for k in keys):
            out[tuple(o[k] for k in keys)].append(o)
    return out


@pytest.mark.parametrize("period", PERIODS)
def test_sales(case, period):
    made, df = case
    every = inside(made, *period)
    sold = kept(every)
    days = [o["order_date"] for o in every if o["order_date"]]
    totals = [o["total"] for o in sold if o["total"] is not None]
    got = rows(sales.sales_overview(df, *period))[0]
    assert got[:4] == (min(days, default=None), max(days, default=None), money(sold), len(sold))
    assert got[4] == (pytest.approx(float(sum(totals)) / len(totals)) if totals else None)

    statuses = Counter(o["order_status"] for o in every if o["order_status"])
    assert rows(sales.orders_by_status_counts(df, *period)) == sorted(statuses.items(), key=lambda s: (-s[1], s[0]))

    for by, measure in (("revenue", money), ("units", lambda g: sum(o["quantity"] or 0 for o in g))):
        ranked = sorted(((measure(g), *k) for k, g in groups(sold, "product", "category").items()),
                        key=lambda t: (-t[0], *t[1:]))[:4]
        assert rows(sales.top_products(df, 4, by, *period)) == [(i, p, c, v) for i, (v, p, c) in enumerate(ranked, 1)]

    for key in ("country", "category", "payment_method", "shipping_zone"):
        table = sorted(((k[0], money(g), len(g)) for k, g in groups(sold, key).items()), key=lambda t: (-t[1], t[0]))
        assert rows(sales.sales_breakdown(df, key, *period)) == table
    months = defaultdict(list)
    for o in sold:
        if o["order_date"]:
            months[f"{o['order_date']:%Y-%m}"].append(o)
    assert rows(sales.sales_breakdown(df, "month", *period)) == sorted((m, money(g), len(g)) for m, g in months.items())


@pytest.mark.parametrize("period", PERIODS)
def test_returns(case, period):
    made, df = case
    every = inside(made, *period)
    asked = [o for o in every if o["return_request_date"]]
    delivered = [o for o in every if o["order_status"] == "delivered"]
    rate = pytest.approx(len(asked) / len(delivered)) if delivered else None
    assert rows(returns.returns_report(df, *period)) == [(len(asked), len(delivered), rate)]
    for key, table in (
        ("return_reason", returns.return_reasons(df, *period)), ("return_status", returns.return_status_counts(df, *period))
    ):
        counts = Counter(o[key] for o in asked if o[key])
        assert rows(table) == sorted(counts.items(), key=lambda s: (-s[1], s[0]))[:5]


@pytest.mark.parametrize("allowed", [0, 5, 10, 30])
def test_late_returns(case, allowed):
    made, df = case
    asked = [o for o in made if o["return_request_date"]]
    late = [d for o in asked if o["delivery_date"] and (d := (o["return_request_date"] - o["delivery_date"]).days) > allowed]
    got = rows(returns.late_return_requests(df, allowed))[0]
    assert got[:2] == (len(asked), len(late))
    assert got[2:] == (pytest.approx(len(late) / len(asked)), pytest.approx(mean(late)) if late else None)


@pytest.mark.parametrize("status,country", [("delivered", ""), ("shipped", "peru"), ("cancelled", "CHILE ")])
def test_order_lists(case, status, country):
    made, df = case
    today = max(o["order_date"] for o in made if o["order_date"])
    matching = [o for o in made if o["order_status"] == status]
    listed = [o for o in matching if not country or (o["country"] or "").lower() == country.strip().lower()]
    # Newest first; an order without a date comes last and has no age.
    listed.sort(key=lambda o: (-(o["order_date"].toordinal() if o["order_date"] else 0), o["order_id"]))
    want = [
        (o["order_id"], (today - o["order_date"]).days if o["order_date"] else None, len(matching), len(listed))
        for o in listed[:20]
    ]
    got = rows(order_desk.list_orders(df, status, country), "order_id", "days_since_order", "status_total", "match_total")
    assert got == want


@pytest.mark.parametrize("period", PERIODS)
def test_charts(case, period):
    made, df = case
    sold = kept(inside(made, *period))
    series = lambda kind, **more: rows(chart_series(df, kind, start_date=period[0], end_date=period[1], **more))
    best = sorted(((money(g), k[0]) for k, g in groups(sold, "product").items()), key=lambda t: (-t[0], t[1]))[:5]
    assert series("top_products", n=5) == [(p, v) for v, p in reversed(best)]
    reasons = Counter(o["return_reason"] for o in sold if o["return_reason"])
    assert [(r[0], r[2]) for r in series("returns_by_reason")] == sorted(reasons.items(), key=lambda s: (-s[1], s[0]))
    methods = Counter(o["payment_method"] for o in sold if o["payment_method"])
    n = sum(methods.values())
    assert [(r[0], r[2], r[3]) for r in series("payment_share")] == [
        (m, c, pytest.approx(c / n)) for m, c in sorted(methods.items(), key=lambda s: (-s[1], s[0]))
    ]
    days = [int(o["delivery_days"]) for o in sold if o["delivery_days"] is not None]
    counts = Counter(days)
    assert series("delivery_days_hist") == ([(d, counts[d]) for d in range(min(days), max(days) + 1)] if days else [])
    got = rows(chart_summary(df, "delivery_days_hist", start_date=period[0], end_date=period[1]))
    assert got == [(pytest.approx(mean(days)), median(days)) if days else (None, None)]
