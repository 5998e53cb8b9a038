"""Weekly tables against a plain-Python recomputation, week by week."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal as D

import pytest

from storelens.lookups import RETURN_BUCKETS
from storelens.operators import weekly
from storelens.operators.ledger import weekly_ledger
from tests.conftest import order, rows

DAY = timedelta(days=1)
STATUSES = ["delivered", "delivered", "delivered", "cancelled", "shipped", "in_transit", "processing", None]
REASONS = [*RETURN_BUCKETS, "odd", None]


def sunday(d):
    return d + DAY * (6 - d.weekday())


def last_sunday(d):
    return d - DAY * ((d.weekday() + 1) % 7)


def random_orders(seed, n=160):
    rng = random.Random(seed)
    start = date(2026, 1, 7)
    made = []
    for i in range(n):
        # Two empty weeks, days at both week ends, some orders without a date.
        offset = rng.choice([*range(0, 25), *range(42, 75)])
        day = None if rng.random() < 0.03 else start + DAY * offset
        status = rng.choice(STATUSES)
        days = rng.randint(1, 9) if status == "delivered" and rng.random() < 0.8 else None
        asked = None
        if rng.random() < 0.35:
            asked = start + DAY * rng.randint(-20, 90)
        made.append(order(
            f"O{i:03d}",
            order_date=day,
            product=rng.choice(["lamp", "desk", "chair", "sofa", "rug", "vase", "bed", None]),
            category=rng.choice(["home", "garden", None]),
            country=rng.choice(["Chile", "Peru", "Peru", None]),
            payment_method=rng.choice(["card", "cash", None]),
            quantity=rng.choice([1, 2, 3, None]),
            installments=rng.choice([1, 3, None]),
            total=rng.choice([10, 20.5, 99.99, None]),
            order_status=status,
            delivery_days=days,
            return_request_date=asked,
            return_reason=rng.choice(REASONS) if asked else None,
            return_status=rng.choice(["approved", "pending", None]) if asked else None,
        ))
    return made


class Plain:
    """The report figures of one week, straight from the rows."""

    def __init__(self, orders, end):
        start = end - DAY * 6
        self.end = end
        self.week = [o for o in orders if o["order_date"] and start <= o["order_date"] <= end]
        self.sold = [o for o in self.week if o["order_status"] != "cancelled"]
        self.filed = [o for o in orders if o["return_request_date"] and start <= o["return_request_date"] <= end]
        self.cancelled = [o for o in self.week if o["order_status"] == "cancelled"]
        days = [o["delivery_days"] for o in self.week
                if o["order_status"] == "delivered" and o["delivery_days"] is not None]
        self.revenue = sum((o["total"] or 0 for o in self.sold), D(0))
        n = len(self.sold)
        self.m = {
            "revenue": float(self.revenue),
            "orders": float(n),
            "aov": float(self.revenue) / n if n else 0.0,
            "cancel_rate": 100 * len(self.cancelled) / len(self.week) if self.week else 0.0,
            "return_rate_filed": 100 * len(self.filed) / n if n else 0.0,
            "avg_delivery_days": sum(days) / len(days) if days else None,
        }

    def by(self, key, group):
        out = defaultdict(list)
        for o in group:
            if o[key] is not None:
                out[o[key]].append(o)
        return out


SEEDS = [1, 2, 3]


@pytest.fixture(scope="module", params=SEEDS)
def case(request, make_orders):
    made = random_orders(request.param)
    dated = [o["order_date"] for o in made if o["order_date"]]
    first, last = sunday(min(dated)), last_sunday(max(dated))
    ends = [first + DAY * 7 * i for i in range((last - first).days // 7 + 1)]
    plain = {e: Plain(made, e) for e in [first - DAY * 7 * i for i in range(1, 5)] + ends}
    df = make_orders(*made).persist()
    yield made, df, ends, plain
    df.unpersist()


def test_metrics(case):
    made, df, ends, plain = case
    got = {r["week_end"]: r for r in weekly.weekly_metrics(df).collect()}
    assert sorted(got) == ends
    for e in ends:
        p, r = plain[e], got[e]
        for name, value in p.m.items():
            assert (r[name] is None) == (value is None)
            assert value is None or float(r[name]) == pytest.approx(value)
        assert (r["placed"], r["cancelled"], r["filed"]) == (len(p.week), len(p.cancelled), len(p.filed))
        assert r["units"] == sum(o["quantity"] or 0 for o in p.sold)
        assert r["instalment_share"] == pytest.approx(
            100 * sum((o["installments"] or 0) > 1 for o in p.sold) / len(p.sold) if p.sold else 0
        )


def pct(a, b):
    return None if a is None or b is None else 0.0 if b == 0 else (a - b) / b * 100


def test_deltas_and_history(case):
    made, df, ends, plain = case
    deltas = {(r["week_end"], r["metric"]): r for r in weekly.weekly_deltas(df).collect()}
    against4 = {(r["week_end"], r["metric"]): r for r in weekly.weekly_vs_avg4(df).collect()}
    series = {(r["week_end"], r["metric"]): r["series"] for r in weekly.weekly_series(df).collect()}
    assert len(deltas) == len(against4) == len(series) == 6 * len(ends)
    for (e, metric), r in deltas.items():
        points = [plain[e - DAY * 7 * i].m[metric] for i in range(5)]
        change = pct(points[0], points[1])
        assert r["delta_pct"] == (None if change is None else pytest.approx(change))
        assert series[e, metric] == [None if p is None else pytest.approx(p) for p in reversed(points)]
        mean = None if None in points[1:] else sum(points[1:]) / 4
        assert against4[e, metric]["avg4"] == (None if mean is None else pytest.approx(mean))
        if change is None or abs(change) < 0.05:
            assert (r["direction"], r["good"]) == ("flat", None)
        else:
            lower = metric in ("cancel_rate", "return_rate_filed", "avg_delivery_days")
            assert r["direction"] == ("up" if change > 0 else "down")
            assert r["good"] == ((change > 0) != lower)


def test_streaks(case):
    made, df, ends, plain = case
    for r in weekly.decline_streak(df).collect():
        g = [plain[r["week_end"] - DAY * 7 * i].m["revenue"] for i in range(5)]

        def run(points):
            n = 0
            for now, before in zip(points, points[1:]):
                if not now < before:
                    break
                n += 1
            return n

        assert (r["streak"], r["previous_streak"]) == (run(g), run(g[1:]))
        assert r["rebound"] == (g[1] != 0 and g[0] > g[1] and g[2] > g[1])


def weekly_rows(df, *columns):
    out = defaultdict(list)
    for r in df.select("week_end", *columns).collect():
        out[r["week_end"]].append(tuple(r)[1:])
    return {e: sorted(v, key=str) for e, v in out.items()}


def expected(ends, plain, build):
    out = {e: sorted(build(plain[e]), key=str) for e in ends}
    return {e: v for e, v in out.items() if v}


def within(table, ends):
    return {e: v for e, v in table.items() if e in ends}


def value(group):
    return sum((o["total"] or 0 for o in group), D(0)).quantize(D("0.01"))


def test_cancellations(case):
    made, df, ends, plain = case
    got = within(weekly_rows(weekly.cancellations_by_country(df), "country", "cancelled", "cancelled_value"), ends)
    assert got == expected(
        ends, plain, lambda p: [(c, len(g), value(g)) for c, g in p.by("country", p.cancelled).items()]
    )
    rolled = within(weekly_rows(weekly.cancellations_rollup(df), "country", "is_total", "cancelled", "cancelled_value"), ends)

    def with_total(p):
        per = [(c, False, len(g), value(g)) for c, g in p.by("country", p.cancelled).items()]
        return per + ([(None, True, len(p.cancelled), value(p.cancelled))] if p.cancelled else [])

    assert rolled == expected(ends, plain, with_total)

    def top(p):
        per = sorted((-len(g), c) for c, g in p.by("country", p.cancelled).items())
        if not per:
            return []
        n, c = -per[0][0], per[0][1]
        return [(c, n, len(p.cancelled), n / max(len(p.cancelled), 1) >= 0.5)]

    got = within(weekly_rows(
        weekly.cancellation_concentration(df), "country", "cancelled", "week_cancelled", "concentrated"), ends)
    assert got == expected(ends, plain, top)


def test_returns(case):
    made, df, ends, plain = case
    bucket = lambda o: RETURN_BUCKETS.get(o["return_reason"], "Other")
    got = within(weekly_rows(weekly.return_buckets(df), "bucket", "requests"), ends)
    assert got == expected(ends, plain, lambda p: list(Counter(map(bucket, p.filed)).items()))
    got = within(weekly_rows(weekly.returns_controllable(df), "filed", "controllable", "value_at_risk"), ends)
    assert got == {
        e: [(len(plain[e].filed), sum(bucket(o) != "Customer choice" for o in plain[e].filed), value(plain[e].filed))]
        for e in ends
    }
    for key, table in (
        ("return_reason", weekly.weekly_return_reasons(df)), ("return_status", weekly.weekly_return_status(df))
    ):
        assert within(weekly_rows(table, key, "requests"), ends) == expected(
            ends, plain, lambda p: [(k, len(g)) for k, g in p.by(key, p.filed).items()]
        )


def top5(p):
    sums = {k: value(g) for k, g in p.by("product", p.sold).items()}
    return sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))[:5]


def test_products(case):
    made, df, ends, plain = case
    got = within(weekly_rows(weekly.weekly_top_products(df), "rank", "product", "revenue"), ends)
    assert got == expected(ends, plain, lambda p: [(i, k, v) for i, (k, v) in enumerate(top5(p), 1)])
    got = within(weekly_rows(weekly.repeat_return_products(df), "product", "requests"), ends)
    assert got == expected(ends, plain, lambda p: [
        (k, len(g)) for k, g in p.by("product", p.filed).items() if len(g) >= 2 and k in dict(top5(p))
    ])


def test_shares(case):
    made, df, ends, plain = case
    for key, table in (
        ("category", weekly.weekly_category_share(df)), ("country", weekly.weekly_country_share(df))
    ):
        got = within(weekly_rows(table, key, "revenue", "share_pct"), ends)
        assert got == expected(ends, plain, lambda p: [
            (k, value(g), pytest.approx(100 * float(value(g)) / float(p.revenue)) if p.revenue else None)
            for k, g in p.by(key, p.sold).items()
        ])
    got = within(weekly_rows(weekly.weekly_payment_share(df), "payment_method", "orders", "share_pct"), ends)
    assert got == expected(ends, plain, lambda p: [
        (k, len(g), pytest.approx(100 * len(g) / len(p.sold))) for k, g in p.by("payment_method", p.sold).items()
    ])


def test_daily_sales(case):
    made, df, ends, plain = case
    revenue = defaultdict(lambda: D("0.00"))
    for o in made:
        if o["order_date"] and o["order_status"] != "cancelled":
            revenue[o["order_date"]] += o["total"] or 0
    days = [ends[0] - DAY * 6 + DAY * i for i in range(7 * len(ends))]
    got = rows(weekly.daily_sales_vs_previous(df).orderBy("day"), "day", "label", "revenue", "previous_revenue")
    assert got == [(d, d.strftime("%a %d"), revenue[d], revenue[d - DAY * 7]) for d in days]


def backlog_at(made, cutoff):
    age = lambda o: (cutoff - o["order_date"]).days
    placed = [o for o in made if o["order_date"] and o["order_date"] <= cutoff]
    way = [age(o) for o in placed if o["order_status"] in ("shipped", "in_transit")]
    wait = [age(o) for o in placed if o["order_status"] == "processing"]
    return (cutoff, len(way), sum(a > 10 for a in way), max(way, default=0), len(wait), sum(a > 2 for a in wait))


def test_backlog(case):
    made, df, ends, plain = case
    assert rows(weekly.weekly_backlog(df).orderBy("cutoff")) == [backlog_at(made, e) for e in ends]
    assert rows(weekly.backlog(df)) == [backlog_at(made, ends[-1])]
    midweek = ends[2] + DAY * 3
    assert rows(weekly.backlog(df, midweek.isoformat())) == [backlog_at(made, midweek)]


def test_alerts(case):
    made, df, ends, plain = case
    got = weekly_rows(weekly.weekly_alerts(df), "alert", "value", "fired")

    def alerts(p):
        _, _, aged, _, _, slow = backlog_at(made, p.end)
        out = [("cancellations", pytest.approx(p.m["cancel_rate"]), p.m["cancel_rate"] > 8),
               ("returns", pytest.approx(p.m["return_rate_filed"]), p.m["return_rate_filed"] > 10)]
        out += [("transit_overdue", float(aged), True)] * (aged > 0)
        return out + [("processing_overdue", float(slow), True)] * (slow > 0)

    assert {e: [r[0] for r in v] for e, v in got.items()} == {
        e: sorted(a[0] for a in alerts(plain[e])) for e in ends
    }
    for e in ends:
        for (name, *rest), want in zip(got[e], sorted(alerts(plain[e]), key=lambda a: a[0])):
            assert (name, *rest) == want


def test_summary_snaps_to_closed_weeks(case):
    made, df, ends, plain = case
    picked = lambda day: {r["week_end"] for r in weekly.report_summary(df, day).collect()}
    assert picked(None) == {ends[-1]}
    assert picked("2030-01-01") == {ends[-1]}
    assert picked(ends[1]) == {ends[1]}
    assert picked((ends[1] + DAY).isoformat()) == {ends[2]}
    one = {r["metric"]: r for r in weekly.report_summary(df, ends[1]).collect()}
    p = plain[ends[1]]
    assert (one["cancel_rate"]["numerator"], one["cancel_rate"]["denominator"]) == (len(p.cancelled), len(p.week))
    assert one["revenue"]["previous"] == pytest.approx(plain[ends[0]].m["revenue"])


def test_threshold_is_exclusive(make_orders):
    # 2 of 25 cancelled is exactly 8 percent and must not fire; 3 of 25 must.
    def week(monday, bad):
        return [order(f"{monday}{i}", order_date=monday, order_status="cancelled" if i < bad else "delivered")
                for i in range(25)]

    df = make_orders(*week("2026-01-05", 2), *week("2026-01-12", 3), order("end", order_date="2026-01-25"))
    fired = {r["week_end"]: r["fired"] for r in weekly.weekly_alerts(df).where("alert = 'cancellations'").collect()}
    assert fired == {date(2026, 1, 11): False, date(2026, 1, 18): True, date(2026, 1, 25): False}


def test_decline_streak_and_rebound(make_orders):
    totals = [100, 90, 80, 70, 75]
    mondays = [date(2026, 1, 5) + DAY * 7 * i for i in range(5)]
    df = make_orders(*[order(str(t), order_date=m, total=t) for t, m in zip(totals, mondays)],
                     order("open", order_date="2026-02-08", total=0))
    got = rows(weekly.decline_streak(df).orderBy("week_end"))
    assert got == [
        (date(2026, 1, 11), 0, 0, False),
        (date(2026, 1, 18), 1, 0, False),
        (date(2026, 1, 25), 2, 1, False),
        (date(2026, 2, 1), 3, 2, False),
        (date(2026, 2, 8), 0, 3, True),
    ]


def test_no_orders_no_weeks(make_orders):
    empty = make_orders(order("A")).where("order_id = 'none'")
    assert rows(weekly_ledger(empty)) == []
    assert rows(weekly.last_closed_week(empty)) == [(None,)]
    assert rows(weekly.daily_sales_vs_previous(empty)) == []


def test_only_an_open_week(make_orders):
    assert rows(weekly.weekly_metrics(make_orders(order("A", order_date="2026-01-05")))) == []
