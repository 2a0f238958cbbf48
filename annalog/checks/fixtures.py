"""The event log that the checks and the bench run on, derived from the `events` table.

Spark expressions and the same in SQL, side by side. Every fixture covers the
whole table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalog.functions.envelope import envelope_json
from annalog.functions.routing import topic_column
from annalog.operators.append import assign_versions, stream_heads
from annalog.operators.replay import ReplayFilter, match, replay_rows
from annalog.schema import COLS
from annalog.sources.messages import message_headers

ROUTES = {"order": "events.order.v1", "user": "events.user.v1"}
FALLBACK = "events.v1"
REPLAY_ID = "replay-1"
REPLAY_TIME = "2024-03-01 00:00:00"
REPLAY_REASON = "consumer was down"


def event_id_text(number: str) -> str:
    return f"concat('00000000-0000-4000-8000-', lpad(cast({number} as string), 12, '0'))"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def unversioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 event columns, version still 0, plus event_id and user_id."""
    domain = "case event_type when 'purchase' then 'order' when 'signup' then 'user' else event_type end"
    cause = event_id_text("event_id div 5 * 5 + (event_id % 5 - 1) div 2")
    return raw_events(spark, sf_dir).selectExpr(
        f"{event_id_text('event_id')} as id",
        "concat('tenant-', event_id div 5 % 4) as tenant_id",
        f"concat({domain}, ':', user_id) as stream_id",
        "concat('user.', event_type) as type",
        "'web-svc' as source",
        "0L as version",
        "1 as event_version",
        "cast(ts as timestamp) as occurred_at",
        "props as payload",
        "map('region', concat('r', user_id % 3)) as metadata",
        "concat('corr-', event_id div 5) as correlation_id",
        f"case when event_id % 5 = 0 then '' else {cause} end as causation_id",
        "concat('user-', user_id) as actor_id",
        "md5(concat('corr-', event_id div 5)) as trace_id",
        "'' as source_version",
        "false as is_replay",
        "'' as replay_id",
        "cast(null as timestamp) as replayed_at",
        "'' as replay_reason",
        "'' as replay_source_event_id",
        "event_id",
        "user_id",
    )


def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`unversioned` with per-stream versions in (time, id) order."""
    return assign_versions(unversioned(spark, sf_dir))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned(spark, sf_dir).select(*COLS)


# The same in SQL. `region` stands for the one metadata key.
CANONICAL = """
base AS (
  SELECT
    '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
    'tenant-' || CAST((event_id // 5) % 4 AS VARCHAR) AS tenant_id,
    (CASE event_type WHEN 'purchase' THEN 'order' WHEN 'signup' THEN 'user' ELSE event_type END)
      || ':' || CAST(user_id AS VARCHAR) AS stream_id,
    'user.' || event_type AS type,
    'web-svc' AS source,
    CAST(1 AS INTEGER) AS event_version,
    CAST(ts AS TIMESTAMP) AS occurred_at,
    props AS payload,
    'r' || CAST(user_id % 3 AS VARCHAR) AS region,
    'corr-' || CAST(event_id // 5 AS VARCHAR) AS correlation_id,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE
      '00000000-0000-4000-8000-' || lpad(CAST((event_id // 5) * 5 + (event_id % 5 - 1) // 2 AS VARCHAR), 12, '0')
    END AS causation_id,
    'user-' || CAST(user_id AS VARCHAR) AS actor_id,
    md5('corr-' || CAST(event_id // 5 AS VARCHAR)) AS trace_id,
    event_id, user_id
  FROM events
),
canonical AS (
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY occurred_at, id) AS version FROM base
)"""


def with_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after replaying every root event of tenant-1 that is an error."""
    log = canonical(spark, sf_dir)
    return log.unionByName(replayed(log))


def replayed(log: DataFrame) -> DataFrame:
    wanted = ReplayFilter(tenant_id="tenant-1", event_type="user.error")
    chosen = match(log, wanted)
    now = F.lit(REPLAY_TIME).cast("timestamp")
    return replay_rows(chosen, stream_heads(log), REPLAY_ID, now, REPLAY_REASON)


_DIGEST = f"md5('{REPLAY_ID}' || chr(31) || id)"
REPLAYED = (
    CANONICAL
    + f""",
heads AS (SELECT stream_id, max(version) AS top FROM canonical GROUP BY stream_id),
replayed AS (
  SELECT
    substr(digest, 1, 8) || '-' || substr(digest, 9, 4) || '-' || substr(digest, 13, 4) || '-'
      || substr(digest, 17, 4) || '-' || substr(digest, 21, 12) AS id,
    tenant_id, stream_id, type, source,
    top + row_number() OVER (PARTITION BY stream_id ORDER BY occurred_at, version, source_id) AS version,
    event_version, CAST('{REPLAY_TIME}' AS TIMESTAMP) AS occurred_at, payload, region,
    correlation_id, causation_id, actor_id, trace_id, source_id
  FROM (SELECT c.*, c.id AS source_id, {_DIGEST} AS digest, h.top
        FROM canonical c JOIN heads h USING (stream_id)
        WHERE tenant_id = 'tenant-1' AND type = 'user.error')
),
whole AS (
  SELECT id, tenant_id, stream_id, type, version, occurred_at, correlation_id, causation_id,
         false AS is_replay, '' AS replay_id, '' AS replay_source_event_id FROM canonical
  UNION ALL
  SELECT id, tenant_id, stream_id, type, version, occurred_at, correlation_id, causation_id,
         true, '{REPLAY_ID}', source_id FROM replayed
)"""
)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per event at offset = event_id; every 20th again later as contract version 2."""
    events = versioned(spark, sf_dir)
    again = events.filter("event_id % 20 = 0").withColumn("event_version", F.lit(2))
    return events.withColumn("offset", F.col("event_id")).unionByName(
        again.withColumn("offset", F.col("event_id") + 10**9)
    )


def bus_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of `deliveries` as a Kafka source has them. Payload 42 on every 31st event,
    value cut in half on every 41st."""
    sent = deliveries(spark, sf_dir).withColumn(
        "payload", F.when(F.col("event_id") % 31 == 0, F.lit("42")).otherwise(F.col("payload"))
    )
    text = envelope_json()
    cut = F.left(text, F.floor(F.char_length(text) / 2).cast("int"))
    return sent.select(
        topic_column(F.col("stream_id"), ROUTES, FALLBACK).alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        "offset",
        F.col("stream_id").cast("binary").alias("key"),
        F.when(F.col("event_id") % 41 == 0, cut).otherwise(text).cast("binary").alias("value"),
        F.col("occurred_at").alias("timestamp"),
        message_headers().alias("headers"),
    )


# Deliveries in SQL: `sent` holds what `bus_messages` carries, `broken` marks cut values.
SENT = (
    CANONICAL
    + f""",
sent AS (
  SELECT d.*, CASE WHEN event_id % 31 = 0 THEN '42' ELSE payload END AS body,
    event_id % 41 = 0 AS broken, event_id % 31 = 0 AS scalar,
    CASE split_part(stream_id, ':', 1) WHEN 'order' THEN 'events.order.v1'
      WHEN 'user' THEN 'events.user.v1' ELSE '{FALLBACK}' END AS topic
  FROM (SELECT *, 1 AS sent_version, event_id AS pos FROM canonical
        UNION ALL
        SELECT *, 2, event_id + 1000000000 FROM canonical WHERE event_id % 20 = 0) d
)"""
)


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a header map: traceparent valid, upper-case, of a wrong version,
    short or absent in turn; X-headers on some rows."""
    trace, span = F.col("trace_id"), F.left(F.md5("id"), F.lit(16))
    turn = F.col("event_id") % 7
    header = (
        F.when(turn == 1, F.concat_ws("-", F.lit("00"), F.upper(trace), span, F.lit("01")))
        .when(turn == 2, F.concat_ws("-", F.lit("01"), trace, span, F.lit("01")))
        .when(turn == 3, F.concat_ws("-", F.lit("00"), F.left(trace, F.lit(31)), span, F.lit("01")))
        .when(turn == 4, F.lit(None))
        .otherwise(F.concat_ws("-", F.lit("00"), trace, span, F.lit("00")))
    )
    every = F.col("event_id")
    names = {
        "traceparent": header,
        "x-trace-id": F.when(every % 2 == 0, F.md5("id")).otherwise(F.lit("short")),
        "x-correlation-id": F.when(every % 3 == 0, F.concat(F.lit("hdr-"), "correlation_id")),
        "x-request-id": F.concat(F.lit("req-"), every.cast("string")),
        "x-causation-id": F.when(every % 4 == 0, F.lit("cause-from-header")).otherwise(F.lit("")),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in names.items()])
    given = F.filter(pairs, lambda p: p["v"].isNotNull())
    return unversioned(spark, sf_dir).withColumn("headers", F.map_from_entries(given))


HEADED = (
    CANONICAL
    + """,
headed AS (
  SELECT *, CASE event_id % 7
      WHEN 1 THEN '00-' || upper(trace_id) || '-' || substr(md5(id), 1, 16) || '-01'
      WHEN 2 THEN '01-' || trace_id || '-' || substr(md5(id), 1, 16) || '-01'
      WHEN 3 THEN '00-' || substr(trace_id, 1, 31) || '-' || substr(md5(id), 1, 16) || '-01'
      WHEN 4 THEN NULL
      ELSE '00-' || trace_id || '-' || substr(md5(id), 1, 16) || '-00' END AS traceparent
  FROM base
),
traced AS (
  SELECT *, CASE WHEN regexp_full_match(traceparent, '00-[0-9a-fA-F]{32}-[0-9a-fA-F]{16}-[^-]{2}')
                 THEN split_part(traceparent, '-', 2) END AS tp_trace
  FROM headed
)"""
)


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read model that lost every 97th event."""
    return unversioned(spark, sf_dir).filter("event_id % 97 <> 0")


def with_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 89th event names a cause that nobody stored."""
    lost = F.concat(F.lit("lost-"), (F.col("event_id") % 5).cast("string"))
    return versioned(spark, sf_dir).withColumn(
        "causation_id", F.when(F.col("event_id") % 89 == 3, lost).otherwise(F.col("causation_id"))
    )


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of every tenth user lose versions 3 and 4 and store version 6 twice."""
    log = versioned(spark, sf_dir)
    hit = F.col("user_id") % 10 == 0
    return log.filter(~(hit & F.col("version").isin(3, 4))).unionByName(
        log.filter(hit & (F.col("version") == 6))
    )


GAPPED = (
    CANONICAL
    + """,
gapped AS (
  SELECT * FROM canonical WHERE NOT (user_id % 10 = 0 AND version IN (3, 4))
  UNION ALL
  SELECT * FROM canonical WHERE user_id % 10 = 0 AND version = 6
)"""
)


def range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six range reads for every stream of a tenant: all of it, versions 2 to 6, from 3 on, a
    span of days, and two that no one can answer."""
    streams = with_gaps(spark, sf_dir).select("tenant_id", "stream_id").distinct()
    days = ("2024-01-05 00:00:00", "2024-01-20 12:00:00")
    kinds = [
        ("all", 0, 0, None, None, True), ("middle", 2, 6, None, None, True), ("tail", 3, 0, None, None, True),
        ("days", 0, 0, *days, True), ("below", -1, 4, None, None, True), ("nameless", 0, 0, None, None, False),
    ]
    types = {"kind": "string", "from_version": "long", "to_version": "long", "from_time": "timestamp", "to_time": "timestamp", "named": "boolean"}
    asked = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(k, types.items(), strict=True)]) for k in kinds])
    rows = streams.select("*", F.inline(asked))
    request_id = F.concat_ws("/", "tenant_id", "stream_id", "kind")
    return rows.select(
        request_id.alias("request_id"), "tenant_id", F.when(F.col("named"), F.col("stream_id")).otherwise("").alias("stream_id"),
        "from_version", "to_version", "from_time", "to_time",
    )


RANGES = (
    GAPPED
    + """,
kinds(kind, from_version, to_version, from_time, to_time, named) AS (VALUES
  ('all', 0, 0, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), true), ('middle', 2, 6, NULL, NULL, true), ('tail', 3, 0, NULL, NULL, true),
  ('days', 0, 0, TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-20 12:00:00', true),
  ('below', -1, 4, NULL, NULL, true), ('nameless', 0, 0, NULL, NULL, false)
),
requests AS (
  SELECT tenant_id || '/' || stream_id || '/' || kind AS request_id, tenant_id, CASE WHEN named THEN stream_id ELSE '' END AS stream_id,
    from_version, to_version, from_time, to_time, CASE WHEN NOT named THEN 'stream_missing' WHEN from_version < 0 THEN 'version_negative' END AS refused
  FROM (SELECT DISTINCT tenant_id, stream_id FROM gapped), kinds
),
found AS (
  SELECT request_id, g.id, g.version, lag(g.version) OVER (PARTITION BY request_id ORDER BY g.version) AS previous
  FROM requests r JOIN gapped g ON g.tenant_id = r.tenant_id AND g.stream_id = r.stream_id AND g.version >= from_version
    AND (to_version = 0 OR g.version <= to_version) AND (from_time IS NULL OR g.occurred_at >= from_time)
    AND (to_time IS NULL OR g.occurred_at <= to_time)
  WHERE refused IS NULL
),
broken AS (
  SELECT request_id, min({'p': previous, 'f': version}) AS gap FROM found WHERE version <> previous + 1 GROUP BY request_id
)"""
)


def service_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of two services for every third correlation, one per event."""
    return raw_events(spark, sf_dir).filter("event_id div 5 % 3 = 0").selectExpr(
        "md5(concat('corr-', event_id div 5)) as trace_id",
        "case when event_id % 2 = 0 then 'workflow' else 'saas' end as service",
        "concat('handled ', event_id) as msg",
    )


def timeline_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline request per purchase: a window around it in some tenant. Bounds
    are text; some are absent, reversed or malformed."""
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    lower = iso.format("cast(ts as timestamp) - interval 3 hours")
    upper = iso.format("cast(ts as timestamp) + make_interval(0, 0, 0, 0, cast(event_id % 30 - 5 as int))")
    return raw_events(spark, sf_dir).filter("event_type = 'purchase'").selectExpr(
        "concat('q', event_id) as request_id",
        "concat('tenant-', event_id % 4) as tenant_id",
        f"case when event_id % 5 = 0 then '' when event_id % 11 = 0 then 'yesterday' else {lower} end as from_time",
        f"case when event_id % 7 = 0 then '' when event_id % 13 = 0 then '2024-01-05' else {upper} end as to_time",
        "cast(event_id % 130 - 10 as int) as `limit`",
        "cast(event_id % 50 - 5 as int) as `offset`",
    )


# DuckDB parses the same bounds; a pattern decides what is malformed.
TIMELINE_REQUESTS = (
    CANONICAL
    + """,
asked AS (
  SELECT 'q' || CAST(event_id AS VARCHAR) AS request_id,
    'tenant-' || CAST(event_id % 4 AS VARCHAR) AS tenant_id,
    CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'yesterday'
      ELSE strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS from_time,
    CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 13 = 0 THEN '2024-01-05'
      ELSE strftime(ts + (event_id % 30 - 5) * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS to_time,
    CASE WHEN event_id % 130 - 10 <= 0 THEN 20 ELSE least(event_id % 130 - 10, 100) END AS n,
    greatest(event_id % 50 - 5, 0) AS skip
  FROM events WHERE event_type = 'purchase'
),
timed AS (
  SELECT *,
    from_time <> '' AND NOT regexp_matches(from_time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') AS bad_from,
    to_time <> '' AND NOT regexp_matches(to_time, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') AS bad_to,
    try_strptime(from_time, '%Y-%m-%dT%H:%M:%SZ') AS from_at,
    try_strptime(to_time, '%Y-%m-%dT%H:%M:%SZ') AS to_at
  FROM asked
)"""
)


def replay_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replay request per signup event, with changing filters and mistakes."""
    g = "event_id div 5"
    iso = "date_format(cast(ts as timestamp) + interval {} hours, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    ids = (
        f"array({event_id_text('event_id')}, {event_id_text('event_id + 1')}, "
        f"{event_id_text('event_id + 1')}, 'no-such-event')"
    )
    return raw_events(spark, sf_dir).filter("event_type = 'signup'").selectExpr(
        "concat('r', event_id) as request_id",
        f"case when event_id % 23 = 0 then '' else concat('tenant-', {g} % 4) end as caller_tenant",
        f"case when event_id % 8 = 3 then '' when event_id % 17 = 0 then 'tenant-9' else concat('tenant-', {g} % 4) end as tenant_id",
        "case when event_id % 4 = 0 then concat('user:', user_id) else '' end as stream_id",
        f"case when event_id % 6 = 1 then concat('corr-', {g}) else '' end as correlation_id",
        "case when event_id % 3 = 0 then 'user.signup' else '' end as event_type",
        "case when event_id % 5 = 2 then concat('user-', user_id) else '' end as actor_id",
        f"case when event_id % 19 = 0 then 'soon' when event_id % 2 = 0 then {iso.format(-24)} else '' end as from_time",
        f"case when event_id % 2 = 0 then {iso.format(24)} else '' end as to_time",
        f"case when event_id % 8 in (3, 5) and event_id % 16 <> 3 then {ids} end as event_ids",
        "event_id % 2 = 0 as dry_run",
        "case when event_id % 29 = 1 then '' else 'recovery' end as replay_reason",
        "cast(event_id % 90 as int) as safety_limit",
    )


REPLAY_REQUESTS = (
    CANONICAL
    + """,
asked AS (
  SELECT event_id, 'r' || CAST(event_id AS VARCHAR) AS request_id,
    CASE WHEN event_id % 23 = 0 THEN '' ELSE 'tenant-' || CAST((event_id // 5) % 4 AS VARCHAR) END AS caller_tenant,
    CASE WHEN event_id % 8 = 3 THEN '' WHEN event_id % 17 = 0 THEN 'tenant-9'
      ELSE 'tenant-' || CAST((event_id // 5) % 4 AS VARCHAR) END AS asked_tenant,
    CASE WHEN event_id % 4 = 0 THEN 'user:' || CAST(user_id AS VARCHAR) ELSE '' END AS f_stream,
    CASE WHEN event_id % 6 = 1 THEN 'corr-' || CAST(event_id // 5 AS VARCHAR) ELSE '' END AS f_corr,
    CASE WHEN event_id % 3 = 0 THEN 'user.signup' ELSE '' END AS f_type,
    CASE WHEN event_id % 5 = 2 THEN 'user-' || CAST(user_id AS VARCHAR) ELSE '' END AS f_actor,
    event_id % 19 = 0 AS bad_from,
    CASE WHEN event_id % 19 <> 0 AND event_id % 2 = 0 THEN date_trunc('second', ts) - INTERVAL 24 HOUR END AS from_at,
    CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) + INTERVAL 24 HOUR END AS to_at,
    event_id % 8 IN (3, 5) AND event_id % 16 <> 3 AS has_ids,
    event_id % 2 = 0 AS dry_run,
    CASE WHEN event_id % 29 = 1 THEN '' ELSE 'recovery' END AS replay_reason,
    CASE WHEN event_id % 90 = 0 THEN 1000 ELSE event_id % 90 END AS safety_limit
  FROM events WHERE event_type = 'signup'
),
judged AS (
  SELECT *, CASE
    WHEN bad_from THEN 'from_time_bad'
    WHEN caller_tenant = '' THEN 'tenant_missing'
    WHEN NOT dry_run AND replay_reason = '' THEN 'reason_missing'
    WHEN asked_tenant = '' AND NOT has_ids THEN 'scope_missing'
    WHEN asked_tenant <> '' AND asked_tenant <> caller_tenant THEN 'tenant_mismatch'
    END AS reject_reason
  FROM asked
),
accepted AS (
  SELECT * , CASE WHEN asked_tenant = '' THEN caller_tenant ELSE asked_tenant END AS tenant_id
  FROM judged WHERE reject_reason IS NULL
),
held AS MATERIALIZED (SELECT id, event_id, tenant_id, stream_id, correlation_id, type, actor_id, occurred_at FROM base),
wanted AS MATERIALIZED (
  SELECT *, CASE WHEN has_ids THEN 'ids' WHEN f_corr <> '' THEN 'corr' WHEN f_stream <> '' THEN 'stream'
    WHEN f_actor <> '' THEN 'actor' WHEN f_type <> '' THEN 'type' ELSE 'tenant' END AS by_field
  FROM accepted
),
near AS (
  SELECT a.*, b.* EXCLUDE (event_id, tenant_id) FROM (SELECT *, unnest([event_id, event_id + 1]) AS asked_id FROM wanted WHERE by_field = 'ids') a
    JOIN held b ON a.tenant_id = b.tenant_id AND a.asked_id = b.event_id
  UNION ALL BY NAME
  SELECT a.*, b.* EXCLUDE (event_id, tenant_id) FROM wanted a JOIN held b ON by_field = 'corr' AND a.tenant_id = b.tenant_id AND f_corr = b.correlation_id
  UNION ALL BY NAME
  SELECT a.*, b.* EXCLUDE (event_id, tenant_id) FROM wanted a JOIN held b ON by_field = 'stream' AND a.tenant_id = b.tenant_id AND f_stream = b.stream_id
  UNION ALL BY NAME
  SELECT a.*, b.* EXCLUDE (event_id, tenant_id) FROM wanted a JOIN held b ON by_field = 'actor' AND a.tenant_id = b.tenant_id AND f_actor = b.actor_id
  UNION ALL BY NAME
  SELECT a.*, b.* EXCLUDE (event_id, tenant_id) FROM wanted a JOIN held b ON by_field = 'type' AND a.tenant_id = b.tenant_id AND f_type = b.type
  UNION ALL BY NAME
  SELECT a.*, b.* EXCLUDE (event_id, tenant_id) FROM wanted a JOIN held b ON by_field = 'tenant' AND a.tenant_id = b.tenant_id
),
hits AS MATERIALIZED (
  SELECT request_id, tenant_id, id FROM near
  WHERE by_field = 'ids' OR (
    (f_stream = '' OR f_stream = stream_id) AND (f_corr = '' OR f_corr = correlation_id)
    AND (f_type = '' OR f_type = type) AND (f_actor = '' OR f_actor = actor_id)
    AND (from_at IS NULL OR occurred_at >= from_at) AND (to_at IS NULL OR occurred_at <= to_at))
),
counted AS (
  SELECT a.request_id, a.tenant_id, a.safety_limit, count(h.id) AS matched_count
  FROM accepted a LEFT JOIN hits h USING (request_id) GROUP BY ALL
)"""
)


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies as callers post them: (event_id, value). Some are cut, too long, or
    carry a number where a text belongs; payload texts have spaces and 1.10."""
    text = {
        "stream_id": F.when(F.col("event_id") % 53 == 0, F.lit("")).otherwise(F.col("stream_id")),
        "type": F.when(F.col("event_id") % 53 == 1, F.lit("")).otherwise(F.col("type")),
        "source": F.col("source"),
        "actor_id": F.col("actor_id"),
    }
    head = F.to_json(F.struct(*[c.alias(n) for n, c in text.items()]))
    number = F.when(F.col("event_id") % 59 == 0, F.lit(',"trace_id":5')).otherwise(F.lit(""))
    pad = F.when(F.col("event_id") % 43 == 1, F.repeat(F.lit("x"), 5000)).otherwise(F.lit("y"))
    payload = F.concat(F.lit('{"n": 1.10, "pad": "'), pad, F.lit('", "type": "inner"}'))
    body = F.concat(
        F.left(head, F.char_length(head) - 1), number, F.lit(',"payload": '), payload,
        F.lit(',"metadata":{"region":"'), F.col("metadata")["region"], F.lit('"}}'),
    )
    cut = F.when(F.col("event_id") % 41 == 0, F.left(body, F.lit(40))).otherwise(body)
    return unversioned(spark, sf_dir).select("event_id", cut.alias("value"))


BODIES = (
    CANONICAL
    + """,
bodies AS (
  SELECT *, event_id % 41 = 0 AS cut, event_id % 43 = 1 AS long, event_id % 59 = 0 AS mistyped,
    CASE WHEN event_id % 53 = 0 THEN '' ELSE stream_id END AS b_stream,
    CASE WHEN event_id % 53 = 1 THEN '' ELSE type END AS b_type
  FROM base
)"""
)


def plain(df: DataFrame) -> DataFrame:
    """UTC wall-clock timestamps without zone: the same in every client."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
