"""Dated list entries and fetch dates for the pages table, which has neither.

Both are derived from the table's own URLs by rules that SQL can repeat: lists
come from the hosts, so they grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.url_filter import host_of

START = "2024-01-01"


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url and fetched_on: a day of 2024."""
    return pages.select("page_id", "url", F.expr(f"date_add(DATE '{START}', CAST(page_id * 37 % 366 AS INT))").alias("fetched_on"))


def entries(pages: DataFrame) -> DataFrame:
    """Block entries for domains, allow entries for hosts below them, block entries for paths; some removed, some added again."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("c"))
    h = hosts.select("host", F.expr("substr(md5(host), 1, 1)").alias("a"), F.expr("substr(md5(host), 2, 1)").alias("b"), F.expr("ascii(substr(md5(host), 3, 1)) * 7 % 200").alias("d"))
    rules = [
        ("regexp_replace(host, '^(www|m)[.]', '')", "blocklist", "block", "add", "d", "a < '8'"),
        ("regexp_replace(host, '^(www|m)[.]', '')", "blocklist", "block", "remove", "d + 90", "a < '8' AND b < '8'"),
        ("regexp_replace(host, '^(www|m)[.]', '')", "blocklist", "block", "add", "d + 150", "a < '8' AND b < '4'"),
        ("host", "allowlist", "allow", "add", "d + 30", "b > '9'"),
        ("host", "allowlist", "allow", "remove", "d + 160", "b > 'c'"),
        ("concat(host, '/en')", "pathlist", "block", "add", "d", "a > '5'"),
        ("host", "greylist", "block", "add", "d + 60", "b > '7' AND a > '7'"),
    ]
    parts = F.array(*[F.expr(f"CASE WHEN {when} THEN named_struct('key', {key}, 'list_name', '{name}', 'verdict', '{verdict}', 'action', '{action}', 'dated', date_add(DATE '{START}', {days})) END") for key, name, verdict, action, days, when in rules])
    return h.select(F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("e")).select("e.*").distinct()


SQL = f"""
WITH c AS (
  SELECT page_id, url, DATE '{START}' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_on,
    regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS host,
    regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages
), h AS (
  SELECT host, substr(md5(host), 1, 1) AS a, substr(md5(host), 2, 1) AS b, ascii(substr(md5(host), 3, 1)) * 7 % 200 AS d
  FROM (SELECT DISTINCT host FROM c WHERE host <> '')
), e AS (
  SELECT DISTINCT * FROM (
    SELECT regexp_replace(host, '^(www|m)[.]', '') AS key, 'blocklist' AS list_name, 'block' AS verdict, 'add' AS action, d AS n FROM h WHERE a < '8'
    UNION ALL SELECT regexp_replace(host, '^(www|m)[.]', ''), 'blocklist', 'block', 'remove', d + 90 FROM h WHERE a < '8' AND b < '8'
    UNION ALL SELECT regexp_replace(host, '^(www|m)[.]', ''), 'blocklist', 'block', 'add', d + 150 FROM h WHERE a < '8' AND b < '4'
    UNION ALL SELECT host, 'allowlist', 'allow', 'add', d + 30 FROM h WHERE b > '9'
    UNION ALL SELECT host, 'allowlist', 'allow', 'remove', d + 160 FROM h WHERE b > 'c'
    UNION ALL SELECT concat(host, '/en'), 'pathlist', 'block', 'add', d FROM h WHERE a > '5'
    UNION ALL SELECT host, 'greylist', 'block', 'add', d + 60 FROM h WHERE b > '7' AND a > '7'
  )
), g AS (
  SELECT key, list_name, DATE '{START}' + CAST(n AS INTEGER) AS dated, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS removed, min(verdict) AS verdict
  FROM e GROUP BY ALL
), i AS (
  SELECT * FROM (SELECT key, list_name, verdict, removed, dated AS valid_from, lead(dated) OVER (PARTITION BY key, list_name ORDER BY dated) AS valid_to FROM g) WHERE removed = 0
), m AS (
  SELECT c.page_id, i.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.key) DESC, CASE WHEN i.verdict = 'block' THEN 0 ELSE 1 END, i.list_name, i.valid_from) AS k
  FROM c JOIN i ON (c.host = i.key OR ends_with(c.host, '.' || i.key) OR c.host || c.path = i.key OR starts_with(c.host || c.path, i.key || '/') AND contains(i.key, '/'))
    AND i.valid_from <= c.fetched_on AND (i.valid_to IS NULL OR c.fetched_on < i.valid_to)
)
SELECT c.page_id, c.url, c.fetched_on, coalesce(m.verdict, 'none') AS verdict, m.key AS matched_key, m.list_name, m.valid_from
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.k = 1
"""
