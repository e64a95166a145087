"""Sensor-like views over the given tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "readings": """SELECT CAST(user_id % 3 AS BIGINT) AS series_id, CAST(date_trunc('hour', ts) AS {ntz}) AS ts,
  CASE WHEN avg(value) FILTER (WHERE event_type = 'error') IS NULL THEN NULL
       WHEN avg(value) FILTER (WHERE event_type = 'error') > 60 THEN avg(value) FILTER (WHERE event_type = 'error') - 60 ELSE 0 END AS target,
  avg(value) FILTER (WHERE event_type = 'view') AS sal, avg(value) FILTER (WHERE event_type = 'click') AS lvl,
  avg(value) FILTER (WHERE event_type = 'signup') AS temp, sum(value) FILTER (WHERE event_type = 'purchase') AS precip
FROM events GROUP BY 1, 2""",
    "iv": """SELECT CAST(user_id % 3 AS BIGINT) AS series_id, event_id AS interval_id, CAST(date_trunc('hour', ts) AS {ntz}) AS start_time,
  CAST(date_trunc('hour', ts) AS {ntz}) + INTERVAL '1' HOUR * CAST(1 + event_id % 12 AS INT) AS end_time,
  CASE event_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'pulse' ELSE 'mixed' END AS label
FROM events WHERE event_type = 'purchase' AND value > 150""",
    "moments": """SELECT series_id, interval_id AS parent_id, CAST(idx AS BIGINT) AS moment_idx,
  start_time + INTERVAL '1' HOUR * CAST((idx - 1) * floor((1 + interval_id % 12) / 2.0) AS INT) AS start_time,
  start_time + INTERVAL '1' HOUR * CAST(idx * floor((1 + interval_id % 12) / 2.0) AS INT) AS end_time,
  CASE (interval_id + idx) % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'oxic' ELSE 'mixed' END AS type
FROM iv CROSS JOIN (VALUES (1), (2)) AS k(idx) WHERE interval_id % 12 >= 1""",
    "scored": """SELECT d.doc_id AS unit_id, d.source AS grp, d.lang, l.quality AS y, l.toxic,
  CAST(d.n_chars % 50 AS DOUBLE) / 50 AS score, CAST(d.n_chars % 2 AS INT) AS pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table by name, made of nothing but the given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].format(ntz="TIMESTAMP_NTZ")
    used = [t for t in (*VIEWS, *TABLES) if f"FROM {t} " in sql + " " or f"FROM {t}\n" in sql or f"JOIN {t} " in sql]
    return spark.sql(sql.replace("FROM iv ", "FROM {iv} ").replace("FROM events ", "FROM {events} ").replace("FROM documents ", "FROM {documents} ").replace("JOIN labels ", "JOIN {labels} "), **{t: view(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    """The named views as DuckDB CTEs, for a statement that goes on with a SELECT or a comma."""
    need = []
    for n in names:
        if n == "moments":
            need.append("iv")
        need.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(ntz='TIMESTAMP')})" for n in dict.fromkeys(need))
