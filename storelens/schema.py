"""Declared schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

ORDER_COLUMNS = (
    "order_id", "order_date", "product", "category", "quantity", "unit_price",
    "total", "payment_method", "installments", "country", "shipping_zone",
    "order_status", "delivery_date", "delivery_days", "return_request_date",
    "return_reason", "return_status",
)
DATE_COLUMNS = ("order_date", "delivery_date", "return_request_date")
REQUIRED_ORDER_COLUMNS = ("order_id", "order_date", "total")

ORDERS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("product", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DecimalType(18, 2)),
    T.StructField("total", T.DecimalType(18, 2)),
    T.StructField("payment_method", T.StringType()),
    T.StructField("installments", T.IntegerType()),
    T.StructField("country", T.StringType()),
    T.StructField("shipping_zone", T.StringType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("delivery_date", T.DateType()),
    T.StructField("delivery_days", T.DoubleType()),
    T.StructField("return_request_date", T.DateType()),
    T.StructField("return_reason", T.StringType()),
    T.StructField("return_status", T.StringType()),
])

INTERACTIONS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("question", T.StringType()),
    T.StructField("tools", T.ArrayType(T.StringType())),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
])

RUNS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("run_type", T.StringType()),
    T.StructField("is_root", T.BooleanType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("inputs", T.StringType()),
    T.StructField("outputs", T.StringType()),
])

GOLD_QUESTIONS = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("questions", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("source", T.StringType()),
    ]))),
])
