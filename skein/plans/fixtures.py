"""Messages, channels, candidates and events derived from the driver's tables.

The tables hold no chat messages, so these views decorate them. Each view is
one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X

MESSAGES = """
SELECT sha1('C_' || event_type || '|' || CAST(event_id AS VARCHAR(20))) AS message_id,
 'C_' || event_type AS channel, event_id, ts AS ts_dt, CAST(user_id AS VARCHAR(20)) AS user_id,
 event_type = 'error' AS is_bot, CASE WHEN event_type='error' AND k % 2 = 0 THEN 'B1' END AS bot_id,
 k % 3 AS reply_count, k % 5 AS reactions_count, k % 7 = 0 AS has_file, k % 11 = 0 AS is_reply, value,
 CASE WHEN event_id % 4 = 3 THEN 'telegram' ELSE 'slack' END AS source_id,
 CASE event_id % 8
  WHEN 0 THEN 'Release v2 PROJ-' || CAST(event_id % 500 AS VARCHAR(20)) || ' see https://Example.com/a/?utm_source=x&id=' || CAST(k AS VARCHAR(20)) || '#frag.'
  WHEN 1 THEN 'Deploy failed github.com/acme/app/issues/' || CAST(event_id % 50 AS VARCHAR(20)) || ' @here please'
  WHEN 2 THEN '`kubectl get` notes <@U1AB> <#C9|General>   join https://meet.google.com/abc-defg-hij'
  WHEN 3 THEN 'launch launch docs https://t.example/p/, www.test.example/x!'
  WHEN 4 THEN 'ABC-1 ABC-1 TEAM-22 DEF-3 GH-4 all at once <!channel>'
  WHEN 5 THEN 'see gitlab.com/grp/proj/-/issues/' || CAST(k AS VARCHAR(20)) || ' and zoom.us/j/' || CAST(event_id AS VARCHAR(20))
  WHEN 6 THEN 'plain chatter, no signal at all'
  ELSE 'link dump https://a.example/1 https://a.example/2 https://a.example/3 https://a.example/4' END AS text
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

EVENTS = """
SELECT lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0') AS event_id, 'm' || CAST(o_orderkey % 700 AS VARCHAR(20)) AS message_id, o_orderkey AS k,
 CASE WHEN o_orderkey % 5 = 4 THEN 'telegram' ELSE 'slack' END AS source_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'risk' WHEN '2-HIGH' THEN 'product' WHEN '3-MEDIUM' THEN 'process' WHEN '4-NOT SPECIFIED' THEN 'marketing' ELSE 'unknown' END AS category,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'planned' ELSE 'started' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS actual_start, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS actual_end,
 CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS planned_start, CAST(NULL AS TIMESTAMP) AS planned_end, CAST(o_orderdate AS TIMESTAMP) AS extracted_at,
 CAST(o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, CAST(o_orderkey % 101 AS INT) AS importance,
 CASE o_orderkey % 4 WHEN 0 THEN 'Launch' WHEN 1 THEN 'Deploy' WHEN 2 THEN 'Incident' ELSE 'Other' END AS action,
 CASE WHEN o_orderkey % 6 = 0 THEN 'wallet.stocks' END AS object_id, '  Object ' || CAST(o_custkey % 40 AS VARCHAR(20)) || CASE WHEN o_orderkey % 9 = 0 THEN ' 2025-01-02 https://x.example' ELSE '' END AS object_name_raw,
 CASE o_orderkey % 5 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' WHEN 2 THEN 'dev' WHEN 3 THEN 'multi' ELSE 'unknown' END AS environment,
 CASE o_orderkey % 7 WHEN 0 THEN 'sev1' WHEN 1 THEN 'sev2' WHEN 2 THEN 'unknown' WHEN 3 THEN 'info' END AS severity,
 CASE WHEN o_orderkey % 8 = 0 THEN 'Wallet team' END AS stroke, CASE WHEN o_orderkey % 3 = 1 THEN 'INV-' || CAST(o_orderkey % 50 AS VARCHAR(20)) END AS anchor,
 CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Summary of ' || CAST(o_orderkey AS VARCHAR(20)) END AS summary,
 'P-' || CAST(o_custkey AS VARCHAR(20)) AS top_anchor, 'C' || CAST(o_orderkey % 3 AS VARCHAR(20)) AS source_channel,
 CAST(o_orderkey % 4 AS INT) AS n_areas, CAST(o_orderkey % 4 AS INT) AS n_qualifiers, CAST(o_orderkey % 5 AS INT) AS n_links
FROM orders
"""

# Settings of the channels, in order; the second row for C_click loses to the first.
CHANNELS = """
SELECT * FROM (VALUES
 (1, 'slack', 'C_click', 'clicks', 15.0D, 10.0D, 8.0D, 5.0D, 3.0D, 4.0D, 2.0D, 3.0D, -15.0D),
 (2, 'slack', 'C_error', 'errors', 5.0D, 10.0D, 8.0D, 5.0D, 3.0D, 4.0D, 2.0D, 3.0D, -15.0D),
 (3, 'slack', 'C_view', 'views', 0.0D, 7.5D, 6.0D, 2.5D, 1.0D, 4.0D, 2.0D, 0.0D, -10.0D),
 (4, 'telegram', 'C_click', 'tg clicks', 10.0D, 10.0D, 8.0D, 5.0D, 3.0D, 4.0D, 2.0D, 3.0D, -15.0D),
 (5, 'telegram', 'C_purchase', 'tg purchases', 0.0D, 10.0D, 8.0D, 5.0D, 3.0D, 4.0D, 2.0D, 3.0D, -15.0D),
 (6, 'slack', 'C_click', 'never', 0.0D, 1.0D, 1.0D, 1.0D, 1.0D, 1.0D, 1.0D, 1.0D, -1.0D)
) AS c(ord, source_id, channel, channel_name, threshold_score, keyword_weight, mention_weight, reply_weight, reaction_weight, anchor_weight, link_weight, file_weight, bot_penalty)
"""
CHANNELS_SQL = CHANNELS.replace("D,", ",").replace("D)", ")")
KEYWORDS = ("release", "Deploy", "launch", "")[:3]
TRUSTED = ("B1",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they come: text and counts, reactions as a map."""
    raw = spark.sql(MESSAGES.replace("FROM events)", "FROM {events})"), events=table(spark, sf_dir, "events"))
    return raw.withColumn("reactions", F.create_map(F.lit("like"), F.col("reactions_count"))).withColumn("blocks_text", F.lit(""))


def normalized(df: DataFrame) -> DataFrame:
    """Messages with normalised text, links and identifiers."""
    raw = df.withColumn("text_norm", X.normalize(F.col("text"))).withColumn("links_raw", X.urls(F.col("text")))
    return raw.withColumn("links_norm", X.normalize_urls(F.col("links_raw"))).withColumn("anchors", X.anchors(F.col("text")))


def channels(spark: SparkSession) -> DataFrame:
    lists = {"whitelist_keywords": KEYWORDS, "trusted_bots": TRUSTED}
    return spark.sql(CHANNELS).withColumns({k: F.array(*map(F.lit, v)) for k, v in lists.items()})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with all the columns of the model."""
    e = spark.sql(EVENTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    items = F.array(F.lit("wallet"), F.lit("search"), F.lit("billing"), F.lit("ops"))
    links = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.when(i == 4, F.lit("ftp://l/")).otherwise(F.lit("https://l/")), i.cast("string"), F.lit("/"), F.col("top_anchor")))
    return e.select(
        "*", F.array("source_channel").alias("source_channels"), F.array("top_anchor").alias("anchors"), F.slice(items, 1, F.col("n_areas")).alias("impact_area"), F.array(F.lit("perf")).alias("impact_type"),
        F.slice(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), 1, F.col("n_qualifiers")).alias("qualifiers"), F.slice(links, 1, F.col("n_links")).alias("links"),
        F.lit("launch").alias("change_type"), F.lit("explicit").alias("time_source"), F.lit(0.5).alias("time_confidence"), F.lit(None).cast("string").alias("why_it_matters"),
    )
