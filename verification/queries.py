"""One runnable query per operator, over whole tables of the driver's warehouse."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens import api
from storelens.functions.columns import localized, mixed_date, money, pretty, whole_number
from storelens.functions.dates import week_end
from storelens.lookups import LABELS_ES
from storelens.operators import (
    charts,
    evaluation,
    order_desk,
    returns,
    sales,
    sections,
    team,
    vectors,
    weekly,
)
from storelens.plans.audit import audit_report
from storelens.sources import documents, logs
from storelens.sources import warehouse as wh
from storelens.sources.scratch import scratch_folder
from storelens.streaming.closed_weeks import closed_weeks
from storelens.streaming.run import run_to_table
from storelens.streaming.topics import topic_windows

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Decimals and doubles as doubles of 6 digits, so that engines can be compared."""

    def plain(name: str, kind: str) -> Column:
        if kind.startswith("decimal"):
            return F.col(name).cast("double").alias(name)
        if kind == "double":
            return F.round(name, 6).alias(name)
        return F.col(name)

    return df.select(*[plain(name, kind) for name, kind in df.dtypes])


def _over(view: Callable[[SparkSession, str], DataFrame], build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(build(view(spark, sf_dir)))


def _orders(build: Callable[..., DataFrame], needs: Iterable[str] | None = None, **params) -> Query:
    """`needs` names the columns a query uses; the view then joins no other tables."""
    return _over(lambda spark, sf_dir: wh.retail_orders(spark, sf_dir, needs), lambda orders: build(orders, **params))


def _listed_orders(**params) -> Query:
    """The newest orders come from dates and statuses; what else is shown is looked up for them alone."""

    def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
        needed = ("order_id", "order_date", "order_status", *(["country"] if params.get("country") else []))
        shown = lambda ids: wh.retail_orders(spark, sf_dir, _LISTED, only=ids)
        return comparable(order_desk.list_orders(wh.retail_orders(spark, sf_dir, needed), attributes=shown, **params))

    return listed


def order_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    order_id = " ord-000000007 "
    return comparable(order_desk.order_lookup(wh.retail_orders(spark, sf_dir, only=order_id), order_id))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of text files in their documents' order: is a page's number its document's place in the file?"""
    pages = wh.stored_pages(spark, sf_dir).select(
        "doc_stem", "page_no", F.regexp_extract("text", r"^(\d+)\n", 1).cast("long").alias("doc_id"), F.expr("substr(text, instr(text, '\n') + 1)").alias("text")
    )
    place = F.row_number().over(W.partitionBy("doc_stem").orderBy("doc_id"))
    return pages.select("doc_id", (place == F.col("page_no")).alias("in_order"), "text")


def read_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes and line breaks out of a sheet export."""
    cells = wh.stored_sheet(spark, sf_dir)
    return cells.select(F.col("order_id").cast("long").alias("doc_id"), "lang", F.col("product").alias("cell"))


_SALES = ("order_id", "order_date", "total", "order_status")
_LISTED = (*_SALES, "country", "product")
_RETURNS = (*_SALES, "delivery_date", "return_request_date", "return_reason", "return_status")
_WEEKLY = (*_SALES, "quantity", "installments", "delivery_days", "return_request_date", "return_reason")


# ---- cleaning -------------------------------------------------------------------


def clean_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = wh.sheet_cells(spark, sf_dir)
    return comparable(cells.select("o_orderkey", money("total").alias("total")))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wh.sheet_cells(spark, sf_dir).select("o_orderkey", mixed_date("order_date").alias("order_date"))


def parse_dates_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable cells, where an unreadable one would fail the query."""
    cells = wh.sheet_cells(spark, sf_dir).where("order_date <> 'unknown'")
    return cells.select("o_orderkey", mixed_date("order_date", strict=True).alias("order_date"))


def clean_delivery_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = wh.sheet_cells(spark, sf_dir)
    return cells.select("o_orderkey", whole_number("delivery_days").alias("delivery_days"))


def localized_labels(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        localized("payment_method", LABELS_ES).alias("payment_label"),
        localized("return_reason", LABELS_ES).alias("reason_label"),
    )


def pretty_labels(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        pretty("payment_method").alias("payment_label"),
        pretty("return_reason").alias("reason_label"),
    )


# ---- filters and calendar -------------------------------------------------------


def orders_in_period(orders: DataFrame) -> DataFrame:
    return sales.in_period(orders, "1998-01-01", "1998-12-31").select("order_id", "order_date", "total")


def non_cancelled(orders: DataFrame) -> DataFrame:
    return sales.non_cancelled(orders).select("order_id", "order_status", "total")


def week_snap(orders: DataFrame) -> DataFrame:
    closed = weekly.last_closed_week(orders).scalar()
    return orders.select(
        "order_id",
        week_end("order_date").alias("week_end"),
        weekly.snap_to_week("order_date", closed).alias("report_week"),
    )


# ---- weekly ---------------------------------------------------------------------


def weekly_series(orders: DataFrame) -> DataFrame:
    names = ("four_back", "three_back", "two_back", "one_back", "current")
    return weekly.weekly_series(orders).select(
        "week_end", "metric", *[F.col("series")[i].alias(n) for i, n in enumerate(names)]
    )


def report_audit(orders: DataFrame) -> DataFrame:
    return audit_report(orders, weekly.weekly_metrics(orders))


# ---- logs -----------------------------------------------------------------------


def trace_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(logs.trace_archive(wh.agent_runs(spark, sf_dir)))


def trace_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = team.trace_tools(wh.agent_runs(spark, sf_dir))
    return roots.select("trace_id", "name", F.explode_outer("tools").alias("t")).select(
        "trace_id", "name", "t.tool", "t.calls"
    )


def _all_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.all_interactions(wh.interaction_log(spark, sf_dir), wh.agent_runs(spark, sf_dir), days=14)


def trace_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = team.traced_interactions(wh.agent_runs(spark, sf_dir), days=None)
    return traced.select("ts", "question")


def interactions_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _all_interactions(spark, sf_dir)
    return rows.select("ts", "question", F.explode_outer("tools").alias("t")).select(
        "ts", "question", "t.tool", "t.calls"
    )


def team_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.team_questions(_all_interactions(spark, sf_dir))


def team_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(team.team_topics(_all_interactions(spark, sf_dir)))


def interaction_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team.interaction_count(_all_interactions(spark, sf_dir))


def content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wh.message_contents(spark, sf_dir).select("conv_id", "turn", team.content_text("content", F.col("is_list")).alias("text"))


# ---- passages -------------------------------------------------------------------


def section_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = sections.section_bodies(sections.section_fragments(wh.policy_pages(spark, sf_dir)))
    return bodies.select("doc_stem", "page_no", "section", "body")


def policy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.policy_chunks(wh.policy_pages(spark, sf_dir))


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as their store gives them back after being written twice."""
    folder = scratch_folder(spark)
    for _ in range(2):
        documents.write_chunks(sections.policy_chunks(wh.policy_pages(spark, sf_dir)), folder)
    return spark.read.parquet(folder).select("passage_id", "section", "text")


def interaction_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it is read back after two appends: each event's second, question and tool."""
    folder = scratch_folder(spark)
    log = wh.interaction_log(spark, sf_dir).withColumn("ts", wh.as_instant("ts"))
    counts = [F.lit(None).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")]
    for half in (0, 1):
        part = log.where((F.crc32(F.col("tools")[0]) % 2) == half)
        logs.append_interactions(part.select("ts", "question", "tools", "latency_s", *counts), folder)
    read = logs.read_interactions(spark, folder)
    return read.select(_wall_clock("ts"), "question", F.col("tools")[0].alias("tool"), "total_tokens")


def gold_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as gold questions: a file of nested JSON per batch, read back as rows."""
    folder = scratch_folder(spark)
    question = F.struct(
        F.col("item_id").cast("int").alias("id"), F.lit("en").alias("lang"), F.lit("benchmark").alias("category"),
        F.col("text").alias("question"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("source"),
    )
    asked = wh.table(spark, sf_dir, "benchmark").select((F.col("item_id") % 7).alias("file"), question.alias("q"))
    asked.groupBy("file").agg(F.collect_list("q").alias("questions")).select("questions").write.option("maxRecordsPerFile", 1).json(folder)
    return logs.read_gold_questions(spark, folder).select("id", "lang", "category", "question", "expected")


def verdict_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two runs, one of them stored again, as the store holds them."""
    folder = scratch_folder(spark)
    verdicts = wh.verdict_rows(spark, sf_dir)
    for run, rows in (("first", verdicts.limit(0)), ("second", verdicts), ("first", verdicts.where("verdict = 'PASS'"))):
        logs.write_verdicts(rows, folder, run)
    return spark.read.parquet(folder).groupBy(F.col("run_id").cast("string").alias("run_id"), "category", "verdict").agg(F.count("*").alias("answers"))


def search_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an encoded corpus, searched for one question."""
    corpus = wh.citations(spark, sf_dir).withColumn("passage_id", F.col("passage_id").cast("long"))
    return api.call("policy_search", vectors.encode_column(corpus, _letters, prefix=""), "a e i o u", _letters, k=3)


def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the stem of their file: a known one for some sources, else the source's name."""
    docs = wh.table(spark, sf_dir, "documents")
    return docs.select("doc_id", sections.document_title(wh.document_stem("source")).alias("title"))


def _letters(texts: list[str]) -> np.ndarray:
    """A fixed arithmetic encoder: how often each vowel occurs, and one."""
    return np.array([[*(t.count(c) for c in "aeiou"), 1] for t in texts], dtype="float64")


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = vectors.encode_column(wh.table(spark, sf_dir, "documents").select("doc_id", "text"), _letters, prefix="")
    return encoded.select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 4).alias("x"))


def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.fixed_window_chunks(wh.table(spark, sf_dir, "documents")).select("doc_id", "start", "text")


def vector_topk_of_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search where every third vector is broken in one of several ways."""
    questions = wh.sample_questions(spark, sf_dir)
    return comparable(vectors.top_passages(wh.broken_vectors(spark, sf_dir), questions))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = wh.sample_questions(spark, sf_dir)
    return comparable(vectors.top_passages(wh.passage_vectors(spark, sf_dir), questions))


def format_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = wh.sample_questions(spark, sf_dir)
    nearest = vectors.top_passages(wh.cited_vectors(spark, sf_dir), questions)
    return vectors.format_passages(vectors.cited(nearest, wh.citations(spark, sf_dir)), questions)


# ---- streams --------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A file stream takes a folder or a pattern; this one matches the table alone.
    schema = wh.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _wall_clock(c: str) -> Column:
    """The UTC wall clock time of an instant, whatever the session's time zone."""
    return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").alias(c)


def stream_topic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = wh.as_interactions(_stream(spark, sf_dir, "events")).withColumn("ts", wh.as_instant("ts"))
    windows = run_to_table(topic_windows(log), mode="update", keys=("window_start", "window_end", "topic"))
    return windows.select(_wall_clock("window_start"), _wall_clock("window_end"), "topic", "calls")


def stream_closed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = wh.as_order_stream(_stream(spark, sf_dir, "orders"), wh.table(spark, sf_dir, "lineitem"))
    return comparable(run_to_table(closed_weeks(orders)))


QUERIES: dict[str, Query] = {
    # cleaning and labels
    "clean_money": clean_money,
    "parse_dates": parse_dates,
    "parse_dates_strict": parse_dates_strict,
    "clean_delivery_days": clean_delivery_days,
    "localized_labels": _orders(localized_labels, ("order_id", "payment_method", "return_reason")),
    "pretty_labels": _orders(pretty_labels, ("order_id", "payment_method", "return_reason")),
    # filters
    "orders_in_period": _orders(orders_in_period, _SALES),
    "non_cancelled": _orders(non_cancelled, _SALES),
    # sales
    "sales_overview": _orders(sales.sales_overview, _SALES),
    "orders_by_status_counts": _orders(sales.orders_by_status_counts, _SALES),
    "top_products_revenue": _orders(sales.top_products, (*_SALES, "product", "category"), n=10),
    "top_products_units": _orders(sales.top_products, (*_SALES, "product", "category", "quantity"), n=10, by="units"),
    "sales_by_month": _orders(sales.sales_breakdown, _SALES, dimension="month"),
    "sales_by_country": _orders(sales.sales_breakdown, (*_SALES, "country"), dimension="country"),
    "sales_by_category": _orders(sales.sales_breakdown, (*_SALES, "category"), dimension="category"),
    "sales_by_payment_method": _orders(sales.sales_breakdown, (*_SALES, "payment_method"), dimension="payment_method"),
    "sales_by_shipping_zone": _orders(sales.sales_breakdown, (*_SALES, "shipping_zone"), dimension="shipping_zone"),
    "sales_overview_of_period": _orders(sales.sales_overview, _SALES, start_date="1997-02-01", end_date="1999-10-31"),
    "top_products_of_period": _orders(sales.top_products, (*_SALES, "product", "category"), start_date="1997-02-01", end_date="1999-10-31"),
    "sales_by_country_since": _orders(sales.sales_breakdown, (*_SALES, "country"), dimension="country", start_date="2000-01-01"),
    # returns
    "returns_report_of_period": _orders(returns.returns_report, _RETURNS, start_date="1997-02-01", end_date="1999-10-31"),
    "returns_report": _orders(returns.returns_report, _RETURNS),
    "return_reasons_top5": _orders(returns.return_reasons, _RETURNS),
    "return_status_counts": _orders(returns.return_status_counts, _RETURNS),
    "late_returns": _orders(returns.late_return_requests, _RETURNS, allowed_days=10),
    # order desk
    "order_lookup": order_lookup,
    "list_orders": _listed_orders(status=" Processing ", limit=100),
    "list_orders_in_country": _listed_orders(status="cancelled", country="nation_3"),
    # weekly report
    "last_closed_week": _orders(weekly.last_closed_week, _SALES),
    "week_snap": _orders(week_snap, ("order_id", "order_date")),
    "weekly_metrics": _orders(weekly.weekly_metrics, _WEEKLY),
    "weekly_deltas": _orders(weekly.weekly_deltas, _WEEKLY),
    "weekly_vs_avg4": _orders(weekly.weekly_vs_avg4, _WEEKLY),
    "weekly_series": _orders(weekly_series, _WEEKLY),
    "decline_streak": _orders(weekly.decline_streak, _WEEKLY),
    "weekly_summary": _orders(weekly.weekly_summary, _WEEKLY),
    "report_summary": _orders(weekly.report_summary, _WEEKLY, week_ending="1999-06-30"),
    "report_summary_early": _orders(weekly.report_summary, _WEEKLY, week_ending="1980-01-01"),
    "weekly_summary_text": _orders(lambda orders: weekly.summary_text(weekly.weekly_summary(orders)), _WEEKLY),
    "cancellations_by_country": _orders(weekly.cancellations_by_country, (*_SALES, "country")),
    "cancellation_concentration": _orders(weekly.cancellation_concentration, (*_SALES, "country")),
    "cancellations_rollup": _orders(weekly.cancellations_rollup, (*_SALES, "country")),
    "return_buckets": _orders(weekly.return_buckets, _RETURNS),
    "returns_controllable": _orders(weekly.returns_controllable, _WEEKLY),
    "weekly_return_reasons": _orders(weekly.weekly_return_reasons, _RETURNS),
    "weekly_return_status": _orders(weekly.weekly_return_status, _RETURNS),
    "weekly_top5": _orders(weekly.weekly_top_products, (*_SALES, "product", "category")),
    "repeat_return_products": _orders(weekly.repeat_return_products),
    "daily_sales_vs_prev": _orders(weekly.daily_sales_vs_previous, _SALES),
    "weekly_category_share": _orders(weekly.weekly_category_share, (*_SALES, "category")),
    "weekly_country_share": _orders(weekly.weekly_country_share, (*_SALES, "country")),
    "weekly_payment_share": _orders(weekly.weekly_payment_share, (*_SALES, "payment_method")),
    "weekly_country_table": _orders(weekly.weekly_country_table, (*_SALES, "country")),
    "weekly_payment_table": _orders(weekly.weekly_payment_table, (*_SALES, "payment_method")),
    "backlog": _orders(weekly.backlog, _WEEKLY),
    "weekly_backlog": _orders(weekly.weekly_backlog, _WEEKLY),
    "weekly_alerts": _orders(weekly.weekly_alerts, _WEEKLY),
    "report_audit": _orders(report_audit, _WEEKLY),
    # charts
    "chart_monthly_sales": _orders(charts.chart_series, _SALES, kind="monthly_sales"),
    "chart_monthly_peak_low": _orders(charts.chart_summary, _SALES, kind="monthly_sales"),
    "chart_top_products": _orders(charts.chart_series, (*_SALES, "product", "category"), kind="top_products", n=40),
    "chart_returns_by_reason": _orders(charts.chart_series, _RETURNS, kind="returns_by_reason", lang="es"),
    "chart_payment_share": _orders(charts.chart_series, (*_SALES, "payment_method"), kind="payment_share", lang="es"),
    "chart_delivery_hist": _orders(charts.chart_series, (*_SALES, "delivery_days"), kind="delivery_days_hist"),
    "chart_delivery_stats": _orders(charts.chart_summary, (*_SALES, "delivery_days"), kind="delivery_days_hist"),
    "chart_sales_by_country": _orders(charts.chart_series, (*_SALES, "country"), kind="sales_by_country"),
    "chart_sales_by_category": _orders(charts.chart_series, (*_SALES, "category"), kind="sales_by_category", lang="es"),
    "chart_top_product": _orders(charts.chart_summary, (*_SALES, "product", "category"), kind="top_products"),
    "chart_top_return_reason": _orders(charts.chart_summary, _RETURNS, kind="returns_by_reason"),
    "chart_top_payment_method": _orders(charts.chart_summary, (*_SALES, "payment_method"), kind="payment_share"),
    "chart_top_country": _orders(charts.chart_summary, (*_SALES, "country"), kind="sales_by_country"),
    "chart_top_category": _orders(charts.chart_summary, (*_SALES, "category"), kind="sales_by_category", lang="es"),
    # logs and traces
    "trace_archive": trace_archive,
    "trace_tools": trace_tools,
    "trace_questions": trace_questions,
    "interactions_union": interactions_union,
    "team_questions": team_questions,
    "team_topics": team_topics,
    "interaction_count": interaction_count,
    "token_usage": _over(wh.message_usage, team.token_usage),
    "content_text": content_text,
    # evaluation
    "parse_verdicts": _over(wh.judge_replies, evaluation.parse_verdicts),
    "verdict_counts": _over(wh.verdict_rows, evaluation.verdict_counts),
    "pass_by_category": _over(wh.verdict_rows, evaluation.pass_by_category),
    # passages
    "read_orders": read_orders,
    "read_pages": read_pages,
    "section_fragments": section_fragments,
    "policy_chunks": policy_chunks,
    "doc_titles": doc_titles,
    "encoded_documents": encoded_documents,
    "fixed_window_chunks": fixed_window_chunks,
    "chunk_store": chunk_store,
    "interaction_store": interaction_store,
    "gold_store": gold_store,
    "verdict_store": verdict_store,
    "search_policies": search_policies,
    "vector_topk": vector_topk,
    "vector_topk_of_mixed": vector_topk_of_mixed,
    "format_passages": format_passages,
    # streams
    "stream_topic_windows": stream_topic_windows,
    "stream_closed_weeks": stream_closed_weeks,
}
