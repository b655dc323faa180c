"""The jobs as registered queries: each runs twice into one new folder and gives its whole output after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from beamloom.sources import store
from jobs import build_events, histograms, settings

HERE = Path(__file__).parent


def _twice(spark: SparkSession, job, name: str, source: str) -> DataFrame:
    folder = f"{store.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    config = settings.read(str(HERE / f"{name}.toml"))
    job.run(spark, source, f"{folder}/out", f"{folder}/checkpoint", config)
    return job.run(spark, source, f"{folder}/out", f"{folder}/checkpoint", config)


def job1_event_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, build_events, "build_events", f"{sf_dir}/events.parquet")


#: The last window of a run is open: nothing has closed it yet.
JOB1_SQL = """
WITH su AS (SELECT event_id // 4096 AS run, event_id AS seq, event_type AS producer, CASE WHEN event_id % 37 = 0 THEN event_id // 3 - 20 ELSE event_id // 3 END AS number,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE (user_id * 1000 + user_id * 1000 + 500) / 2000.0 END AS ts FROM events),
k AS (SELECT *, max(CASE WHEN producer = 'click' THEN number END) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM su),
kept AS (SELECT * FROM k WHERE top IS NULL OR number >= top),
o AS (SELECT run, number, min(seq) AS opened FROM kept WHERE producer = 'click' GROUP BY run, number),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY number) - 1 AS event_id, max(number) OVER (PARTITION BY run) AS last FROM o),
j AS (SELECT kept.*, r.event_id, r.opened FROM kept JOIN r USING (run, number) WHERE number < last),
t AS (SELECT run, number, arg_min(ts, (seq <> opened, seq)) AS ts FROM j WHERE ts IS NOT NULL GROUP BY run, number)
SELECT run, event_id, number, seq, producer, coalesce(t.ts, 0.0)::DOUBLE AS window_ts FROM j LEFT JOIN t USING (run, number)
"""


def job2_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, histograms, "histograms", sf_dir)


JOB2_SQL = """
WITH f AS (
  SELECT 'lineitem' AS "table", 'P' || (l_linenumber - 1) AS path, 'hitCharge' AS plot, l_quantity AS x, 60 AS n, -0.5 AS lo, 59.5 AS hi, NULL AS y FROM lineitem
  UNION ALL SELECT 'lineitem', 'P' || (l_linenumber - 1), 'hitMap', l_partkey % 24, 24, -0.5, 23.5, l_suppkey % 24 FROM lineitem
  UNION ALL SELECT 'documents', coalesce(source, '(none)'), 'entryLength', length(text), 50, 0.0, 5000.0, NULL FROM documents
  UNION ALL SELECT 'documents', coalesce(lang, '(none)'), 'entryLines', len(string_split(text, chr(10))), 40, 0.5, 40.5, NULL FROM documents)
SELECT "table", path, plot, floor((x - lo) / ((hi - lo) / n))::INT AS ix, coalesce(floor((y + 0.5) / (24.0 / 24)), 0)::INT AS iy, count(*)::DOUBLE AS content
FROM f WHERE x >= lo AND x < hi AND path IS NOT NULL GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_event_building": job1_event_building, "job2_histograms": job2_histograms}


def oracle_sql() -> dict[str, str]:
    return {"job1_event_building": JOB1_SQL, "job2_histograms": JOB2_SQL}
