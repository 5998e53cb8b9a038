"""Queries on tables where single keys hold a third of all rows, without broadcast joins."""

import pytest

from verification.compare import TABLES, compare, duck

SF = "/root/testdata/sf0.001"

HOT = {
    # A third of the lines belong to one order, a third of the products are one product,
    # a third of the orders one customer's.
    "lineitem": """SELECT * REPLACE (
        CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN l_orderkey % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey) FROM {t}""",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey) FROM {t}",
    # A third of the questions are the same, of the turns one conversation's, of the
    # text one document's.
    "events": """SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN '{{"k": 1}}' ELSE props END AS props) FROM {t}""",
    "conversations": "SELECT * REPLACE (CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id) FROM {t}",
    "documents": """SELECT * FROM {t} WHERE doc_id % 3 <> 0 UNION ALL
        SELECT 0, string_agg(text, chr(10) ORDER BY doc_id), 'en', 'src0', sum(n_chars)::BIGINT FROM {t} WHERE doc_id % 3 = 0""",
    # Copies: equal vectors, told apart by their ids.
    "embeddings": "SELECT * REPLACE (vec_id + 1000 * i AS vec_id) FROM {t}, range(3) r(i)",
}

QUERIES = [
    "weekly_metrics", "weekly_alerts", "weekly_top5", "repeat_return_products", "sales_by_country", "top_products_units",
    "cancellations_rollup", "weekly_category_share", "list_orders", "report_audit", "chart_delivery_hist",
    "team_questions", "team_topics", "trace_tools", "interactions_union", "token_usage",
    "section_fragments", "fixed_window_chunks", "vector_topk", "format_passages",
]


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    con = duck(SF)
    for t in TABLES:
        source = f"'{SF}/{t}.parquet'"
        query = HOT.get(t, "SELECT * FROM {t}").format(t=source)
        con.execute(f"COPY ({query}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder, duck(folder)


@pytest.fixture
def big_cluster(spark):
    """Plans as for tables too large to broadcast, every skewed partition split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys(big_cluster, hot, name):
    folder, con = hot
    problem = compare(big_cluster, con, folder, name)
    assert problem in ("", "(no rows on either side)" if name == "repeat_return_products" else "")
