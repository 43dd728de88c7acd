"""The jobs as registered queries, each run twice into a folder of its own, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import frame_quality, response_report
from kinegrid.plans.window_plans import ONSETS, UNITS
from kinegrid.session import fresh_folder


def job1_frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "frame-quality")
    for _ in range(2):  # the second run finds nothing new
        found = frame_quality.run(spark, f"{sf_dir}/documents.parquet", folder)
    return found.drop("part")


def job2_response_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "response-report")
    for _ in range(2):
        found = response_report.run(spark, f"{sf_dir}/events.parquet", folder)
    return found


MEASURES = ", ".join(frame_quality.MEASURES)
JOB1_SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 'none' ELSE source END AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS chars, len(regexp_extract_all(t, '\p{{L}}')) AS letter FROM d),
f AS (
  SELECT doc_id, source, len(words) AS n_words, CASE WHEN chars > 0 THEN 1000 * letter // chars ELSE 0 END AS letters,
    CASE WHEN len(words) > 0 THEN 1000 * len(list_distinct(words)) // len(words) ELSE 0 END AS distinct_words,
    CASE WHEN len(words) > 0 THEN 100 * chars // len(words) ELSE 0 END AS word_length,
    1000 - 1000 * len(list_distinct(lines)) // len(lines) AS repeated_lines
  FROM w
),
u AS (UNPIVOT f ON {MEASURES} INTO NAME measure VALUE v),
m AS (SELECT source, measure, median(CAST(v AS DOUBLE)) AS med, count(*) AS n, CAST(sum(v) AS DOUBLE) AS s1, CAST(sum(v * v) AS DOUBLE) AS s2 FROM u GROUP BY ALL),
a AS (SELECT source, measure, median(abs(v - med)) AS mad FROM u JOIN m USING (source, measure) GROUP BY ALL),
l AS (SELECT source, measure, med, 3.5 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sqrt(greatest(0.0, n * s2 - s1 * s1)) / n END AS wide FROM m JOIN a USING (source, measure)),
o AS (SELECT doc_id, source, string_agg(u.measure, ',' ORDER BY list_position(['n_words', 'letters', 'distinct_words', 'word_length', 'repeated_lines'], u.measure)) AS reasons, count(*) AS n_out
  FROM u JOIN l USING (source, measure) WHERE v < med - wide OR v > med + wide GROUP BY ALL)
SELECT f.doc_id, f.source, {MEASURES}, coalesce(n_out, 0) AS n_out, coalesce(reasons, '') AS reasons FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.source = f.source
"""

JOB2_SQL = f"""
WITH ev AS (SELECT user_id AS site, event_type AS channel, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, coalesce(value, 0.0) AS v FROM events),
days AS (SELECT unnest(range(0, (SELECT max(t) + 1 FROM ev))) AS t, (SELECT max(t) + 1 FROM ev) AS frames),
sums AS (SELECT channel, site, t, sum(v) AS v FROM ev WHERE site IS NOT NULL AND channel IS NOT NULL AND t >= 0 GROUP BY ALL),
sites AS (SELECT DISTINCT site FROM sums),
patches AS (SELECT sites.site, days.t, frames, coalesce(v, 0.0) AS v FROM sites CROSS JOIN days LEFT JOIN sums ON sums.site = sites.site AND sums.t = days.t AND channel = 'view'),
{UNITS}, {ONSETS},
series AS (SELECT c.channel, sites.site, days.t, coalesce(v, 0.0) > 0 AS active FROM (SELECT DISTINCT channel FROM sums WHERE channel <> 'view') c CROSS JOIN sites CROSS JOIN days LEFT JOIN sums ON sums.site = sites.site AND sums.t = days.t AND sums.channel = c.channel),
sp AS (SELECT roi, l AS lag, start + l AS s, least((SELECT max(frames) FROM days), start + l + 3) AS e FROM onsets, (SELECT unnest([-2, -1, 0, 1, 2, 3]) AS l) WHERE start + l >= 0),
h AS (SELECT channel, site, lag, s, max(CAST(active AS INT)) AS hit FROM sp JOIN series ON site // 15 = roi AND t >= s AND t < e WHERE s < e GROUP BY ALL),
r AS (SELECT channel, site, lag, count(*) AS windows, CAST(sum(hit) AS BIGINT) AS hits FROM h GROUP BY ALL),
b AS (SELECT channel, site, avg(hit) AS prob FROM (SELECT channel, site, max(CAST(active AS INT)) OVER w AS hit, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY channel, site ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3 GROUP BY ALL),
d AS (SELECT * FROM r JOIN b USING (channel, site)),
tail AS (SELECT channel, site, lag, sum(exp(lgamma(windows + 1) - lgamma(i + 1) - lgamma(windows - i + 1) + i * ln(prob) + (windows - i) * ln(1 - prob))) AS tail FROM (SELECT *, unnest(range(hits, windows + 1)) AS i FROM d WHERE prob > 0 AND prob < 1) GROUP BY ALL)
SELECT site, site // 15 AS roi, CAST(lag AS BIGINT) AS lag, windows, hits, round(hits / windows, 6) AS rate, round(prob, 6) AS baseline, round(hits / windows - prob, 6) AS lift,
  round(CASE WHEN hits <= 0 THEN 1.0 WHEN prob <= 0 THEN 0.0 WHEN prob >= 1 THEN 1.0 ELSE least(1.0, tail) END, 6) AS p_value, channel
FROM d LEFT JOIN tail USING (channel, site, lag)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_frame_quality, job2_response_report)}


def oracle_sql() -> dict[str, str]:
    return {"job1_frame_quality": JOB1_SQL, "job2_response_report": JOB2_SQL}
