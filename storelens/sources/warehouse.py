"""The library's inputs as views over a TPC-H-like warehouse.

Nothing here is an operator: it maps given tables onto the orders, log, run, page
and verdict schemas, so that every operator runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.columns import lookup
from storelens.lookups import DOCUMENT_TITLES
from storelens.sources.documents import read_pages
from storelens.sources.orders import read_orders
from storelens.sources.scratch import scratch_folder

_PAYMENT = {
    "1-URGENT": "credit_card",
    "2-HIGH": "debit_card",
    "3-MEDIUM": "digital_wallet",
    "4-NOT SPECIFIED": "bank_transfer",
    "5-LOW": "cash_on_delivery",
}
_REASONS = (
    "defective_product", "not_as_described", "arrived_damaged",
    "changed_mind", "wrong_size_or_model", "other_reason",
)
_RETURN_STATUS = ("approved", "rejected", "pending")
_EVENT_TOOLS = {
    "click": "top_products",
    "view": "sales_overview",
    "purchase": "returns_report",
    "signup": "order_lookup",
}
SYSTEM_NOTE = "\\n\\n[System note: reply in the language of the question.]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_instant(wall_clock: str) -> Column:
    """A time without zone as the UTC instant that reads the same."""
    return F.from_utc_timestamp(F.col(wall_clock).cast("timestamp"), F.current_timezone())


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


_OF_PART = frozenset({"product", "category", "unit_price"})
_OF_LINES = _OF_PART | {"quantity", "return_request_date", "return_reason", "return_status"}
_OF_PLACE = frozenset({"country", "shipping_zone"})


def retail_orders(
    spark: SparkSession, sf_dir: str, columns: Collection[str] | None = None, only: str | DataFrame | None = None
) -> DataFrame:
    """One row per order; `columns` names those wanted, in any order, and only the tables they need are joined.

    The product of an order is its lowest part, the quantity that of all its lines; it may
    come back if a line was returned. Orders without lines, parts or buyers stay, with
    NULL in their place. Each 101st order has no status, each 103rd no total and each
    97th no country, as in a sheet that people keep.

    Lines are summed up per order by fixed-width sums before the shuffle, so an order with
    very many lines costs no more than others. Join sides are left to the optimizer, which
    broadcasts a table only when its known size is under the session's threshold.

    `only` leaves one order, by its id, or the few whose ids a table of at most a list's
    length holds. Ids are turned back into keys, so that both scans see the condition and
    only these orders' lines are summed.
    """
    wanted = set(columns) if columns is not None else _OF_LINES | _OF_PLACE
    joined, all_lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if isinstance(only, DataFrame):
        # A listed order is one of MAX_LISTED at most.
        keys = F.broadcast(only.select(key_of(F.col("order_id")).alias("key")).distinct())
        joined = joined.join(keys, F.expr("o_orderkey = key"), "left_semi")
        all_lines = all_lines.join(keys, F.expr("l_orderkey = key"), "left_semi")
    elif only is not None:
        key = order_key(only)
        joined, all_lines = joined.where(F.col("o_orderkey") == F.lit(key)), all_lines.where(F.col("l_orderkey") == F.lit(key))
    if wanted & _OF_LINES:
        lines = all_lines.groupBy("l_orderkey").agg(
            F.min("l_partkey").alias("l_partkey"),
            F.sum("l_quantity").alias("l_quantity"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("came_back"),
        )
        joined = joined.join(lines, F.expr("o_orderkey = l_orderkey"), "left")
    if wanted & _OF_PART:
        joined = joined.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"), "left")
    if wanted & _OF_PLACE:
        places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"), "left")
        buyers = table(spark, sf_dir, "customer").join(places, F.expr("c_nationkey = n_nationkey"), "left")
        joined = joined.join(buyers, F.expr("o_custkey = c_custkey"), "left")
    # What was not joined is not asked for either.
    joined = joined.withColumns({
        c: F.lit(None).cast(kind) for c, kind in (
            ("l_partkey", "long"), ("l_quantity", "double"), ("came_back", "int"), ("p_name", "string"), ("p_type", "string"),
            ("p_retailprice", "double"), ("n_name", "string"), ("r_name", "string")) if c not in joined.columns
    })

    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    status = (
        F.when(key % 101 == 0, F.lit(None).cast("string"))
        .when(key % 13 == 0, "cancelled")
        .when((day >= "2001-07-20") & (key % 5 == 0), "processing")
        .when((day >= "2001-07-05") & (key % 5 == 1), "shipped")
        .when((day >= "2001-07-05") & (key % 5 == 2), "in_transit")
        .otherwise("delivered")
    )
    dated = joined.select(
        order_id(key).alias("order_id"),
        day.alias("order_date"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"),
        F.when(key % 103 != 0, F.col("o_totalprice")).cast("decimal(18,2)").alias("total"),
        lookup("o_orderpriority", _PAYMENT).alias("payment_method"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1 + key % 12)
        .otherwise(1).cast("int").alias("installments"),
        F.when(key % 97 != 0, F.col("n_name")).alias("country"),
        F.col("r_name").alias("shipping_zone"),
        status.alias("order_status"),
        F.when(status == "delivered", 2 + key % 9).cast("int").alias("days"),
        (F.expr("came_back = 1 and (o_orderkey div 3) % 3 = 0")).alias("may_return"),
        "o_orderkey", "l_partkey",
    )
    delivered_on = F.date_add("order_date", F.col("days"))
    requested_on = F.when(
        F.col("may_return"),
        F.date_add(delivered_on, F.expr("cast((o_orderkey div 4) % 20 as int)")),
    )
    returned = requested_on.isNotNull()
    orders = dated.select(
        *dated.columns[:12],
        delivered_on.alias("delivery_date"),
        F.col("days").cast("double").alias("delivery_days"),
        requested_on.alias("return_request_date"),
        F.when(returned, _pick(_REASONS, F.col("l_partkey") % 6)).alias("return_reason"),
        F.when(returned, _pick(_RETURN_STATUS, F.col("o_orderkey") % 3)).alias("return_status"),
    )
    return orders if columns is None else orders.select(*[c for c in orders.columns if c in wanted])


def order_key(text: str) -> int | None:
    """The key that `order_id` writes so, or None."""
    digits = text.strip().upper().removeprefix("ORD-")
    key = int(digits) if digits.isascii() and digits.isdigit() else None
    known = key is not None and key < 2**63 and text.strip().upper() == f"ORD-{key:09d}"
    return key if known else None


def key_of(text: Column) -> Column:
    return F.regexp_extract(text, r"^ORD-(\d+)$", 1).try_cast("long")


def order_id(key: Column) -> Column:
    """`ORD-` and the key in nine digits, or in as many as it has."""
    digits = key.cast("string")
    return F.concat(F.lit("ORD-"), F.repeat(F.lit("0"), F.greatest(9 - F.length(digits), F.lit(0))), digits)


def as_order_stream(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """A stream of warehouse orders in the shape of placed orders, with the units of their lines.

    `lines` is a stored table, read anew for each batch: the lines have no time of their own
    that lies near their order's, so a join of two streams could never let go of an order.
    """
    units = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("units"))
    return orders.join(units, F.expr("o_orderkey = l_orderkey"), "left").select(
        as_instant("o_orderdate").alias("order_ts"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.col("units").cast("int").alias("quantity"),
        F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("delivered").alias("order_status"),
    )


# Shapes that a sheet exports. Two figures of a year and days before months are only
# read one way where the other is no date, so the day is above 12 there.
_WRITTEN = (
    "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy", "yyyy/MM/dd", "M/d/yyyy h:mm a", "yyyy-MM-dd h:mm a", "d-MMM-yyyy",
    "EEE, d MMM yyyy", "EEEE, MMMM d, yyyy", "yyyy.MM.dd", "MM.dd.yyyy", "MMM d, yyyy HH:mm", "d MMMM yyyy", "yyyyMMdd", "yyyy-MM-dd",
)


def _written(key: Column, moment: Column) -> Column:
    """The date in one of the shapes, by the order's key; September in four letters now and then."""
    # One shape is written per row; an array to pick from would write them all.
    text = F.lit(None).cast("string")
    for k, shape in enumerate(_WRITTEN):
        text = F.when(key % len(_WRITTEN) == k, F.date_format(moment, shape)).otherwise(text)
    return F.when(key % 2 == 0, F.regexp_replace(text, r"\bSep\b", "Sept")).otherwise(text)


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a sheet would show them: money, dates and days as human text."""
    kind = F.col("o_orderpriority")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    plain = amount.cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(kind == "1-URGENT", F.concat(F.lit("$"), F.format_number(amount, 2)))
        .when(kind == "2-HIGH", plain)
        .when(kind == "3-MEDIUM", F.concat(F.lit("  "), plain, F.lit(" ")))
        .when(kind == "4-NOT SPECIFIED", F.concat(F.lit("("), plain, F.lit(")")))
        .otherwise("").alias("total"),
        F.when(kind == "5-LOW", "unknown").otherwise(_written(F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp"))).alias("order_date"),
        F.when(kind == "5-LOW", "").when(kind == "4-NOT SPECIFIED", "n/a")
        .otherwise((F.col("o_orderkey") % 30).cast("string")).alias("delivery_days"),
    )


def interaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged questions: the properties ask, the event type is the tool."""
    return as_interactions(table(spark, sf_dir, "events"))


def as_interactions(events: DataFrame) -> DataFrame:
    return events.select(
        "ts",
        F.col("props").alias("question"),
        F.array(lookup("event_type", _EVENT_TOOLS, default=F.col("event_type"))).alias("tools"),
        F.col("value").alias("latency_s"),
    )


def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs, four to a trace, the first one of a trace being its root."""
    trace = F.expr("event_id div 4")
    text = F.regexp_replace("props", '["{}]', "")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        trace.cast("string").alias("trace_id"),
        F.col("event_type").alias("name"),
        F.when(F.col("event_id") == trace * 4, "chain").otherwise("tool").alias("run_type"),
        (F.col("event_id") == trace * 4).alias("is_root"),
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("end_time"),
        F.col("user_id").alias("total_tokens"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), text)).alias("error"),
        F.when(
            F.col("event_type") != "error",
            F.concat(F.lit("{'messages': [{'content': '"), text, F.lit(SYSTEM_NOTE + "'}]}")),
        ).alias("inputs"),
        F.col("props").alias("outputs"),
    )


def message_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages with token usage; a system turn reports none."""
    length = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("interaction_id"),
        F.when(F.col("role") == "user", length).alias("input_tokens"),
        F.when(F.col("role") == "assistant", length).alias("output_tokens"),
    )


def message_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as message contents: plain text, or a JSON list of blocks.

    A user's third turn looks like a list but is text; an assistant's blocks end in a
    string that looks like an object. `is_list` has the type that the sender gave.
    """
    assistant = F.col("role") == "assistant"
    block = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    blocks = F.concat(
        F.lit("["), block(type=F.lit("text"), text=F.col("text")), F.lit(","),
        block(type=F.lit("signature"), text=F.lit(None).cast("string")), F.lit(',"{end}"]'),
    )
    looks_listed = F.concat(F.lit('["{'), F.length("text").cast("string"), F.lit('}", 2]'))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(assistant, blocks).when(F.col("turn") == 2, looks_listed).otherwise(F.col("text")).alias("content"),
        assistant.alias("is_list"),
    )


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document labels as replies of a judge: fenced, plain and unreadable ones.

    Every seventh reply of a good document says something after its object, every
    eleventh is in single quotes and every thirteenth has a verdict that is none.
    """
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    verdict = (
        F.when(F.col("doc_id") % 13 == 0, "MAYBE").when(good & ~toxic, "PASS").when(good & toxic, "PARTIAL").otherwise("FAIL")
    )
    body = F.to_json(F.struct(verdict.alias("verdict"), F.concat(F.lit("doc "), "doc_id").alias("reason")))
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(~good & toxic, F.concat(F.lit("cannot say: "), body))
        .when(good & (F.col("doc_id") % 7 == 0), F.concat(body, F.lit(' {"verdict":"FAIL"}')))
        .when(good & (F.col("doc_id") % 11 == 0), F.replace(body, F.lit('"'), F.lit("'")))
        .when(good, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body).alias("reply"),
    )


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as verdicts per category; no document needs a review."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    verdict = (
        F.when(good & ~toxic, "PASS").when(good & toxic, "PARTIAL")
        .when(~good & ~toxic, "FAIL").otherwise("ERROR")
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    return (
        table(spark, sf_dir, "labels")
        .join(documents, "doc_id")
        .select(F.col("doc_id").alias("id"), "category", verdict.alias("verdict"))
    )


def document_stem(source: str) -> Column:
    """File stems for sources: each third of them is one of the policy documents."""
    stems = sorted(DOCUMENT_TITLES)
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.when(number % 3 == 0, _pick(tuple(stems), (number.cast("int") % len(stems)))).otherwise(F.col(source))


def policy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of ten lines, some lines numbered like section headings.

    All inside one row per document: no line is shuffled to build a page.
    """
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when((i + 1) % 4 == 2, F.concat((i + 1).cast("string"), F.lit(". "), line))
        .otherwise(line),
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    pages = F.transform(
        F.sequence(F.lit(0), F.size("lines") - 1, F.lit(10)),
        lambda at: F.array_join(F.slice("lines", at + 1, 10), "\n"),
    )
    return documents.select("doc_id", F.posexplode(pages).alias("pos", "text")).select(
        F.col("doc_id").cast("string").alias("doc_stem"), (F.col("pos") + 1).alias("page_no"), "text"
    )


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of a few text files, written in order of doc_id and read back: a page
    begins with its doc_id."""
    text = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), "\f", " "))
    folder = scratch_folder(spark)
    pages = table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    pages.select(text.alias("value")).write.option("lineSep", "\f").text(folder)
    return read_pages(spark, folder)


def stored_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a sheet export, with their quotes and line breaks, written and read back as orders are."""
    folder = scratch_folder(spark)
    cells = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("order_id"), "lang",
        F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('",\n"')).alias("product"),
    )
    cells.write.options(header="true", escape='"', quoteAll="true").csv(folder)
    return read_orders(spark, folder)


def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding")


def broken_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, every third of which is missing, empty, too short, or holds a NULL, NaN or infinity."""
    x, n = F.col("embedding"), F.size("embedding")
    instead = lambda value: F.concat(F.slice(x, 1, n - 1), F.array(F.lit(value).cast("float")))
    kind = F.expr("(passage_id div 3) % 6")
    broken = (
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.slice(x, 1, 0)).when(kind == 2, F.slice(x, 1, n - 1))
        .when(kind == 3, instead(None)).when(kind == 4, instead(float("nan"))).otherwise(instead(float("inf")))
    )
    vectors = passage_vectors(spark, sf_dir)
    return vectors.withColumn("embedding", F.when(F.col("passage_id") % 3 == 0, broken).otherwise(x))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages to cite: the text, titled by its source, as the pages of a corpus."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("passage_id"),
        "text",
        F.col("source").alias("title"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("page_label"),
    )


def cited_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of those passages; only the documents' ids are read."""
    return passage_vectors(spark, sf_dir).join(citations(spark, sf_dir).select("passage_id"), "passage_id", "left_semi")


def sample_questions(spark: SparkSession, sf_dir: str) -> list[tuple[str, list[float]]]:
    """Three question vectors out of the whole table: its mean and its two corners.

    The driver receives one aggregated row per vector component, however many vectors.
    """
    vectors = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    stats = vectors.groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    rows = stats.orderBy("i").collect()
    return [
        ("mean", [r["mean"] for r in rows]),
        ("low", [float(r["low"]) for r in rows]),
        ("high", [float(r["high"]) for r in rows]),
    ]
