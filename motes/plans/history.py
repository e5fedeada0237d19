"""Ready-made queries on selection histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.operators import history as ops
from motes.plans.registry import query
from motes.plans.standins import HISTORY, history, table, with_

STEPS = """b AS (SELECT *, min(metric) OVER (PARTITION BY session ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before,
    row_number() OVER (PARTITION BY session ORDER BY iteration) AS pos, lag(n) OVER (PARTITION BY session ORDER BY iteration) AS prev FROM hist),
i AS (SELECT *, pos > 1 AND metric < best_before AS improved FROM b)"""


def _steps_sql(progress: str) -> str:
    return (
        with_(HISTORY, STEPS)
        + f""", m AS (SELECT *, max(CASE WHEN pos = 1 OR {progress} THEN pos END) OVER (PARTITION BY session ORDER BY iteration) AS last FROM i)
    SELECT session, iteration, n, metric, least(metric, coalesce(best_before, metric)) AS best, improved IS TRUE AS improved, pos - last AS not_improved FROM m"""
    )


@query("r8_history_fixed", _steps_sql("improved"))
def history_fixed(spark, sf_dir):
    return ops.iteration_history(history(spark, sf_dir)).withColumn("improved", F.coalesce("improved", F.lit(False)))


@query("r8_history_stability", _steps_sql("n <> prev"))
def history_stability(spark, sf_dir):
    return ops.iteration_history(history(spark, sf_dir), stability=True).withColumn("improved", F.coalesce("improved", F.lit(False)))


@query(
    "r9_retained_share",
    with_(HISTORY)
    + """SELECT session, iteration, n, metric, round(n * 100.0 / first_value(n) OVER w, 6) AS retained_pct, round(metric - first_value(metric) OVER w, 6) AS metric_delta
    FROM hist WINDOW w AS (PARTITION BY session ORDER BY iteration)""",
)
def retained_share(spark, sf_dir):
    out = ops.retained_share(history(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("retained_pct", "metric_delta")})


RESULTS = """r1 AS (SELECT o_custkey % 7 AS session, o_custkey % 50 AS n, round(avg(o_totalprice) / 10000) AS metric, 'first' AS origin FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
r2 AS (SELECT o_custkey % 7 AS session, o_custkey % 50 AS n, round(avg(o_totalprice) / 10000) AS metric, 'second' AS origin FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
merged AS (SELECT session, n, metric, max(origin) AS origin FROM (FROM r1 UNION ALL FROM r2) GROUP BY 1, 2, 3)"""


def _results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")

    def one(part, name):
        return (
            part.groupBy((F.col("o_custkey") % 7).alias("session"), (F.col("o_custkey") % 50).alias("n"))
            .agg(F.round(F.avg("o_totalprice") / 10000).alias("metric"))
            .withColumn("origin", F.lit(name))
        )

    return one(o.filter("o_orderkey % 2 = 0"), "first"), one(o.filter("o_orderkey % 3 = 0"), "second")


@query("r10_merge_results", with_(RESULTS) + "SELECT * FROM merged")
def merge_results(spark, sf_dir):
    return ops.merge_results(*_results(spark, sf_dir), ["session"], "n", "metric")


@query(
    "r10_best_and_largest",
    with_(RESULTS)
    + """SELECT session, arg_min(n, metric * 1000 + n) AS best_n, min(metric) AS best_metric, max(n) AS largest_n, arg_min(metric, (0 - n) * 100000 + metric) AS largest_metric FROM merged GROUP BY 1""",
)
def best_and_largest(spark, sf_dir):
    merged = ops.merge_results(*_results(spark, sf_dir), ["session"], "n", "metric")
    return ops.best_and_largest(merged, ["session"], "n", "metric")


@query("r11_best_count", with_(HISTORY) + "SELECT session, n AS best_n FROM hist QUALIFY row_number() OVER (PARTITION BY session ORDER BY metric, iteration) = 1")
def best_count(spark, sf_dir):
    return ops.best_count(history(spark, sf_dir), ["session"], "n", "metric", "iteration")


CURVE = """curve AS (SELECT vec_id AS map, i AS pos, (i + 1) / 128.0 AS f, CASE WHEN i % 13 = 12 THEN 'nan'::DOUBLE ELSE CAST(embedding[i + 1] AS DOUBLE) * 3 END AS y
    FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)), clean AS (SELECT map, pos, f, CASE WHEN isnan(y) THEN -1 ELSE y END AS y FROM curve),
nx AS (SELECT *, lead(y) OVER w AS y2, lead(f) OVER w AS f2 FROM clean WINDOW w AS (PARTITION BY map ORDER BY pos))"""


@query(
    "r12_threshold_crossing",
    with_(CURVE)
    + """, c AS (SELECT map, arg_min(f + (y - 0.143) / (y - y2) * (f2 - f), pos) AS fc FROM nx WHERE y >= 0.143 AND y2 < 0.143 GROUP BY map)
    SELECT map, round(fc, 8) AS frequency, round(1 / fc, 6) AS resolution FROM c""",
)
def threshold_crossing(spark, sf_dir):
    curve = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select(
        F.col("vec_id").alias("map"),
        F.col("i").cast("bigint").alias("at"),
        ((F.col("i") + 1) / 128.0).alias("f"),
        F.when(F.col("i") % 13 == 12, F.lit(float("nan"))).otherwise(F.col("v").cast("double") * 3).alias("y"),
    )
    out = ops.threshold_crossing(curve, ["map"], "f", "y", 0.143, "at")
    return out.select("map", F.round("frequency", 8).alias("frequency"), F.round("resolution", 6).alias("resolution"))


@query(
    "r13_next_settings",
    _steps_sql("improved").replace("SELECT session, iteration, n, metric", ", h AS (SELECT session, iteration, n / 100.0 AS sigma, metric", 1)
    + """), l AS (SELECT session, arg_max(sigma, iteration) AS sigma, arg_max(not_improved, iteration) AS k FROM h GROUP BY 1)
    SELECT session, round(greatest(CASE WHEN CASE WHEN k > 0 THEN session % 2 = 0 ELSE session % 3 = 0 END THEN sigma - 0.25 ELSE sigma END, 0.5), 2) AS next_sigma,
      k >= 3 AS stop, k > session AS switch_subset FROM l""",
)
def next_settings(spark, sf_dir):
    hist = ops.iteration_history(history(spark, sf_dir)).withColumn("sigma", F.col("n") / 100.0)
    s = F.col("session")
    settings = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).cast("bigint").alias("session")).distinct().select(
        "session", F.lit(0.25).alias("step"), F.lit(0.5).alias("floor"), (s % 3 == 0).alias("decay_improved"), (s % 2 == 0).alias("decay_not_improved"),
        F.lit(3).alias("stop_after"), s.alias("switch_after"),
    )
    return ops.next_settings(hist, settings)
