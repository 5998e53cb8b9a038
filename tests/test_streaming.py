import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from storelens.operators import weekly
from storelens.schema import INTERACTIONS
from storelens.sources.logs import append_interactions, stream_interactions
from storelens.sources.orders import stream_orders, write_orders
from storelens.sources.scratch import scratch_folder
from storelens.streaming.closed_weeks import closed_weeks
from storelens.sources.published import publish, published_folders
from storelens.streaming.run import changes_into, read_changes, run_to_table
from storelens.streaming.topics import topic_windows
from storelens.sources.warehouse import as_interactions, table
from tests.conftest import rows
from tests.test_weekly import random_orders

SF = "/root/testdata/sf0.001"
ORDERS = "order_ts timestamp, total decimal(18,2), quantity int, order_status string"


def write_in_order(folder, files):
    folder.mkdir()
    for i, lines in enumerate(files):
        path = folder / f"part{i}.json"
        path.write_text("\n".join(json.dumps(x) for x in lines))
        os.utime(path, (1_700_000_000 + i * 100,) * 2)


@pytest.fixture
def orders_folder(tmp_path):
    def at(ts, total, status="delivered"):
        return {"order_ts": ts, "total": total, "quantity": 1, "order_status": status}

    write_in_order(tmp_path / "orders", [
        [at("2026-07-06T10:00:00", 10), at("2026-07-12T23:00:00", 5), at("2026-07-07T23:00:00", 99, "cancelled")],
        [at("2026-07-14T09:00:00", 7), at("2026-07-12T20:00:00", 3, None)],
        [at("2026-07-22T09:00:00", 1)],
        [at("2026-07-11T09:00:00", 100), at("2026-07-23T09:00:00", 2)],
    ])
    return str(tmp_path / "orders")


def test_weeks_come_out_once_closed(spark, orders_folder):
    stream = spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", 1).json(orders_folder)
    got = sorted(rows(run_to_table(closed_weeks(stream))))
    # The order of 12 July that arrives late still counts, the one of 11 July comes too late.
    assert [(r[0], float(r[1]), *r[2:]) for r in got] == [
        (date(2026, 7, 12), 18.0, 3, 4, 1, 3),
        (date(2026, 7, 19), 7.0, 1, 1, 0, 1),
    ]


def test_closed_weeks_equal_the_batch_report(spark):
    rows_in = table(spark, SF, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_ts"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.lit(2).alias("quantity"),
        F.when(F.col("o_orderkey") % 9 == 0, "cancelled").otherwise("delivered").alias("order_status"),
    )
    stored = scratch_folder(spark) + "/orders"
    rows_in.repartition(3).write.parquet(stored)
    stream = spark.readStream.schema(rows_in.schema).parquet(stored)
    got = run_to_table(closed_weeks(stream))
    batch = rows_in.withColumn("order_date", F.to_date("order_ts"))
    for name in ("installments", "delivery_days", "return_reason"):
        batch = batch.withColumn(name, F.lit(None).cast("int" if name != "return_reason" else "string"))
    batch = batch.withColumn("return_request_date", F.lit(None).cast("date"))
    want = weekly.weekly_metrics(batch).where("placed > 0").select(*got.columns)
    weeks = {g[0] for g in rows(got)}
    assert sorted(rows(got)) == sorted(r for r in rows(want) if r[0] in weeks)
    # Everything but the weeks the watermark has not passed yet is out.
    assert 0 <= want.count() - got.count() <= 1


def test_weeks_of_stored_orders(spark, make_orders):
    made = [o for o in random_orders(21) if o["order_date"]]
    stored = scratch_folder(spark) + "/orders"
    write_orders(make_orders(*made), stored)
    got = rows(run_to_table(closed_weeks(stream_orders(spark, stored), time="order_date")).orderBy("week_end"))
    want = weekly.weekly_metrics(spark.read.parquet(stored)).where("placed > 0").orderBy("week_end")
    want = rows(want, "week_end", "revenue", "orders", "placed", "cancelled", "units")
    # The watermark trails the latest order by a day, so the last week may be open still.
    assert got == want[:len(got)] and len(want) - len(got) <= 1


def test_live_log(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = lambda day, tools: spark.createDataFrame(
        [(datetime(2026, 7, day, 10), "q", tools, 1.0, 1, 1, 2)], INTERACTIONS)
    append_interactions(batch(1, ["top_products", "top_products"]), log)
    append_interactions(batch(2, ["order_lookup"]), log)
    out = run_to_table(topic_windows(stream_interactions(spark, log, 1), slide="7 days"), mode="complete")
    assert sorted(rows(out, "topic", "calls")) == [("Order lookup", 1), ("Sales & products", 2)]


def test_topic_windows_stream_equals_batch(spark):
    events = as_interactions(table(spark, SF, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    stored = scratch_folder(spark) + "/events"
    events.repartition(3).write.parquet(stored)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(stored)
    want = sorted(rows(topic_windows(events)))
    assert sorted(rows(run_to_table(topic_windows(stream), mode="complete"))) == want
    assert len(want) == 144


def test_append_gives_closed_windows_only(spark):
    events = as_interactions(table(spark, SF, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    stored = scratch_folder(spark) + "/events"
    events.coalesce(1).write.parquet(stored)
    stream = spark.readStream.schema(events.schema).parquet(stored)
    got = set(rows(run_to_table(topic_windows(stream))))
    want = set(rows(topic_windows(events)))
    assert got < want
    latest = events.agg(F.max("ts")).first()[0]
    assert all(r[1] <= latest for r in got)


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    folder = tmp_path / "log"
    line = lambda day, tool: {"ts": f"2026-07-{day:02d}T10:00:00", "tools": [tool]}
    write_in_order(folder, [[line(1, "top_products"), line(2, "list_orders")]])
    work = str(tmp_path / "work")

    def totals():
        stream = spark.readStream.schema("ts timestamp, tools array<string>").json(str(folder))
        out = run_to_table(topic_windows(stream, slide="7 days"), mode="complete", folder=work)
        return dict(rows(out.groupBy("topic").agg(F.sum("calls"))))

    assert totals() == {"Sales & products": 1, "Other": 1}
    (folder / "more.json").write_text(json.dumps(line(3, "top_products")))
    assert totals() == {"Sales & products": 2, "Other": 1}


KEYS = ("window_start", "window_end", "topic")


def test_updates_equal_the_batch_result_and_state_goes(spark, tmp_path):
    """Days in order, a file each: changed windows only are written, and old windows leave the state."""
    folder = tmp_path / "log"
    days = [[{"ts": f"2026-07-{day:02d}T10:00:00", "tools": ["top_products"] * day}] for day in range(1, 21)]
    write_in_order(folder, days)
    work = str(tmp_path / "work")
    schema = "ts timestamp, tools array<string>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    made = run_to_table(topic_windows(stream), mode="update", folder=work, keys=KEYS)
    assert sorted(rows(made)) == sorted(rows(topic_windows(spark.read.schema(schema).json(str(folder)))))
    changed = [spark.read.parquet(path).count() for _, path in published_folders(spark, f"{work}/result")]
    assert max(changed) <= 7 and len(changed) >= 20
    state = spark.read.format("statestore").load(f"{work}/checkpoint").count()
    assert state <= 9 < made.count()


def test_a_batch_that_stops_halfway_and_runs_again(spark, tmp_path):
    target, schema = str(tmp_path / "table"), "k int, n int"
    put = changes_into(target, ["k"], fold_after=3)
    batch = lambda *pairs: spark.createDataFrame(pairs, schema)
    now = lambda: sorted(rows(read_changes(spark, target, batch().schema, ["k"])))
    assert now() == []
    put(batch((1, 1), (2, 1)), 0)

    class Stopped(Exception):
        pass

    def stop_after(folder):
        batch((2, 9)).write.parquet(folder)
        raise Stopped

    with pytest.raises(Stopped):
        publish(spark, target, stop_after, 1, whole=False)
    assert now() == [(1, 1), (2, 1)]
    put(batch((2, 2), (3, 2)), 1)
    put(batch((2, 7), (3, 7)), 1)
    assert now() == [(1, 1), (2, 2), (3, 2)]
    put(batch((1, 3)), 2)
    assert len(published_folders(spark, target)) == 1 and now() == [(1, 3), (2, 2), (3, 2)]
    put(batch(), 3)
    put(batch((4, 4)), 4)
    assert now() == [(1, 3), (2, 2), (3, 2), (4, 4)]
    with pytest.raises(ValueError):
        changes_into(target, [])


def test_no_input_no_rows(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema(ORDERS).json(str(tmp_path / "empty"))
    assert rows(run_to_table(closed_weeks(stream))) == []


def test_scratch_folder_follows_the_cluster_setting(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = scratch_folder(spark)
    assert shared is None or folder.startswith(shared.rstrip("/") + "/")
    assert folder != scratch_folder(spark)
