"""The jobs as queries: each runs twice over the whole given tables into a new folder, and its output is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import collection_report, detect_arrivals
from jobs.common import defaults
from stratavox.queries import LAB
from stratavox.runtime import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_detect_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, s = _folder(spark, "job1"), defaults(detect_arrivals.__file__)
    for _ in range(2):
        detect_arrivals.run(spark, sf_dir, f"{folder}/out", f"{folder}/checkpoint", s)
    return detect_arrivals.read_output(spark, f"{folder}/out")


def job2_collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, s = _folder(spark, "job2"), defaults(collection_report.__file__)
    for _ in range(2):
        collection_report.run(spark, sf_dir, f"{folder}/out", s)
    return collection_report.read_output(spark, f"{folder}/out")


QUERIES: dict[str, Query] = {"job1_detect_arrivals": job1_detect_arrivals, "job2_collection_report": job2_collection_report}

_WORDS = "[^\\x20\\x09-\\x0D]+"
ORACLE_SQL: dict[str, str] = {
    "job1_detect_arrivals": f"""WITH RECURSIVE {LAB}, found AS (
  SELECT cz, cy, cx, label, min((z * 1000 + y) * 1000 + x) AS f, count(*) AS volume, CAST(sum(v) AS DOUBLE) AS sum_intensity FROM lab GROUP BY ALL
), chunks AS (SELECT vec_id // 64 AS cz, count(DISTINCT vec_id) AS layer_chunks FROM embeddings GROUP BY 1)
SELECT cz AS layer, cz, cy, cx, label, f // 1000000 AS z, f // 1000 % 1000 AS y, f % 1000 AS x, CAST(1 AS BIGINT) AS count, volume, sum_intensity,
  layer_chunks, count(*) OVER w AS layer_objects, CAST(sum(volume) OVER w AS BIGINT) AS layer_volume
FROM found JOIN chunks USING (cz) WINDOW w AS (PARTITION BY cz)""",
    "job2_collection_report": f"""WITH mark AS (SELECT doc_id, max(quality) AS mark FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id), object AS (
  SELECT coalesce(source, 'unassigned') AS specimen, lang, concat_ws('/', lang, CASE mark WHEN 0 THEN 'poor' WHEN 1 THEN 'good' ELSE 'unmarked' END) AS leaf,
    len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS volume, coalesce(length(text), 0) AS chars, doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND coalesce(length(text), 0) > 0 AS good
  FROM documents LEFT JOIN mark USING (doc_id)
), specimens AS (
  SELECT specimen, count(*) AS objects, count(*) FILTER (good) AS placed, CASE WHEN count(*) FILTER (NOT good) > 0.5 * count(*) THEN 'set aside' ELSE 'complete' END AS status FROM object GROUP BY specimen
), usable AS (SELECT o.* FROM object o JOIN specimens s USING (specimen) WHERE good AND status = 'complete'), tree AS (
  SELECT DISTINCT UNNEST([{{'r': 'all', 'p': NULL}}, {{'r': lang, 'p': 'all'}}, {{'r': leaf, 'p': lang}}], recursive := true) FROM usable
), totals AS (
  SELECT s.specimen, t.r AS region, t.p AS parent, CAST(count(u.leaf) AS BIGINT) AS count, CAST(coalesce(sum(u.volume), 0) AS BIGINT) AS volume, CAST(coalesce(sum(chars), 0) AS BIGINT) AS sum_intensity
  FROM specimens s CROSS JOIN tree t LEFT JOIN usable u ON u.specimen = s.specimen AND (t.r = 'all' OR t.r = u.lang OR t.r = u.leaf) WHERE status = 'complete' GROUP BY ALL
)
SELECT s.specimen, objects, placed, status, region, parent, count, volume, sum_intensity, CASE WHEN volume <> 0 THEN sum_intensity / volume::DOUBLE END AS iov FROM specimens s LEFT JOIN totals USING (specimen)""",
}
