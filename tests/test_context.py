"""The flat context: campaign performance, the names of the affected campaigns and the first findings, beside the counts."""

import datetime as dt

from adlens.plans import catalog as C
from adlens.plans import findings_queries as Q


def star(spark, folder, suppliers=14, rows=420, hot=()):
    """The tables of the ad facts with ``rows`` line items; those of the suppliers in ``hot`` have some far above the others."""
    def put(name, values, ddl):
        spark.createDataFrame(values, ddl).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    put("region", [(0, "EAST"), (1, "WEST")], "r_regionkey long, r_name string")
    put("nation", [(0, 0), (1, 1)], "n_nationkey long, n_regionkey long")
    put("supplier", [(i, f"Shop {i:02d}", i % 2) for i in range(suppliers)], "s_suppkey long, s_name string, s_nationkey long")
    put("orders", [(i, f"{1 + i % 3}-P") for i in range(rows // 2)], "o_orderkey long, o_orderpriority string")
    item = lambda i: (i // 2, 1 + i % 3, i % suppliers, dt.datetime(2025, 1, 1) + dt.timedelta(days=i % 40), 10.0,
                      (90_000.0 if i % suppliers in hot and i % 4 == 0 else 1_000.0) + i % 37, 0.05, 0.06)
    put("lineitem", [item(i) for i in range(rows)],
        "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    return folder


def test_context_has_campaigns_names_and_first_findings(spark, tmp_dir):
    d = star(spark, tmp_dir, hot=(4, 8))
    row = C.queries()["anomaly_context"](spark, d).first()
    found = Q.findings(spark, d).collect()
    names = sorted({r.campaign_name for r in found})
    assert row.affected_campaign_names == "|".join(names) and row.affected_campaigns == len(names) < row.campaign_count == 14
    assert {"Shop 04", "Shop 08"} <= set(names)
    first = sorted(found, key=lambda r: (-r.z, r.date, r.campaign_name, r.metric, r.value))[:10]
    assert row.anomaly_details.split("|") == [r.description for r in first] and len(found) == row.total_anomalies > 10
    best = row.top_campaigns.split("|")
    assert len(best) == 10 and {x.split(":")[0] for x in best[:2]} == {"Shop 04", "Shop 08"}


def test_context_without_findings(spark, tmp_dir):
    d = star(spark, tmp_dir, suppliers=3, rows=4)
    row = C.queries()["anomaly_context"](spark, d).first()
    assert (row.total_anomalies, row.affected_campaign_names, row.anomaly_details) == (0, "", "") and row.top_campaigns.count("|") == 2
