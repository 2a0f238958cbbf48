"""The registered queries: each operator on the whole fixture log, with the same
result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalog.checks import fixtures as fx
from annalog.functions.envelope import envelope_json, indexable, rfc3339
from annalog.functions.routing import route_by_table, stream_prefix, topic_column
from annalog.functions.trace import (
    coalesce_id,
    format_traceparent,
    parse_traceparent,
    resolve_trace,
    span_of,
)
from annalog.operators import audit, audit_queries as q, causation, ingest, paging, reconcile, replay, runs
from annalog.operators import request_tables as rt
from annalog.operators.append import append_result
from annalog.plans import jobs
from annalog.schema import COLS
from annalog.sources.dlq import dlq_messages, to_dlq
from annalog.sources.messages import (
    decode_messages,
    from_envelope_json,
    message_context,
    order_for_export,
    to_messages,
    to_wire9,
)
from annalog.schema import MESSAGE_SCHEMA
from annalog.session import cut_lineage, run_dir
from annalog.sources.labels import read_labels, update_labels
from annalog.sources.log import append_batch, read_heads, read_log
from annalog.sources.messages import read_messages
from annalog.sources.projection import POSITION, latest_by_id, merge_projection, read_projection, upsert_projection
from annalog.sources.requests import decode_requests
from annalog.streaming.jobs import ProjectionPaths, index_error, run_ingest, run_log_projection, run_projection, run_publish

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TENANT = "tenant-1"
ROW = ["id", "tenant_id", "stream_id", "type", "version", "occurred_at", "correlation_id", "payload"]
ROW_SQL = ", ".join(ROW)


def case(sql: str | None = None, ctes: str = fx.CANONICAL):
    """Register a query under its function's name, with its SQL."""

    def register(fn: Query) -> Query:
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fx.plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"WITH {ctes.strip()}\n{sql.strip()}"
        return fn

    return register


def brief(df: DataFrame) -> DataFrame:
    return df.select(*ROW, F.col("metadata")["region"].alias("region"))


# ---------------------------------------------------------------- scans, wire forms


@case("""
SELECT id, tenant_id, stream_id, type, source, version, event_version, occurred_at, payload, region,
  correlation_id, causation_id, actor_id, trace_id, '' AS source_version, false AS is_replay,
  '' AS replay_id, CAST(NULL AS TIMESTAMP) AS replayed_at, '' AS replay_reason, '' AS replay_source_event_id
FROM canonical""")
def log_scan(spark, sf_dir):
    rows = fx.canonical(spark, sf_dir)
    return rows.withColumn("region", F.col("metadata")["region"]).drop("metadata")


@case("""
SELECT id, stream_id, type, source, version, occurred_at, payload AS payload_text, region, correlation_id
FROM canonical""")
def wire9(spark, sf_dir):
    rows = to_wire9(fx.canonical(spark, sf_dir))
    return rows.withColumns(
        {"payload_text": F.col("payload").cast("string"), "region": F.col("metadata")["region"]}
    ).drop("payload", "metadata")


_TIME = "strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(occurred_at, '.%f'), '0'), '.') || 'Z'"
_ENVELOPE = f"""
'{{"id":"' || id || '","tenant_id":"' || tenant_id || '","stream_id":"' || stream_id || '","type":"' || type
  || '","source":"' || source || '","version":' || version || ',"event_version":' || event_version
  || ',"occurred_at":"' || {_TIME} || '","correlation_id":"' || correlation_id || '"'
  || CASE WHEN causation_id = '' THEN '' ELSE ',"causation_id":"' || causation_id || '"' END
  || ',"actor_id":"' || actor_id || '","trace_id":"' || trace_id || '","payload":' || payload
  || ',"metadata":{{"region":"' || region || '"}}}}'"""


@case(f"SELECT id, {_ENVELOPE} AS envelope FROM canonical")
def envelope_write(spark, sf_dir):
    return fx.canonical(spark, sf_dir).select("id", envelope_json().alias("envelope"))


@case(f"SELECT {ROW_SQL}, event_version, causation_id, actor_id, trace_id, region, 'ok' AS status FROM canonical")
def envelope_read(spark, sf_dir):
    text = fx.canonical(spark, sf_dir).select(envelope_json().alias("value"))
    rows = from_envelope_json(text)
    return rows.select(
        *[f"event.{c}" for c in [*ROW, "event_version", "causation_id", "actor_id", "trace_id"]],
        F.col("event.metadata")["region"].alias("region"),
        F.coalesce("decode_error", F.lit("ok")).alias("status"),
    )


_TOPIC = f"""CASE split_part(stream_id, ':', 1) WHEN 'order' THEN 'events.order.v1'
  WHEN 'user' THEN 'events.user.v1' ELSE '{fx.FALLBACK}' END"""


@case(f"""
SELECT id, {_TOPIC} AS topic, stream_id AS key_text, occurred_at AS sent_at, type AS h_type, source AS h_source,
  '00-' || trace_id || '-' || substr(md5(id), 1, 16) || '-01' AS h_traceparent,
  correlation_id AS h_correlation, 5 AS n_headers
FROM base""")
def bus_messages(spark, sf_dir):
    """S3: topic, key, time and headers of the published messages."""
    rows = to_messages(fx.unversioned(spark, sf_dir), fx.ROUTES, fx.FALLBACK)
    h = F.transform(F.col("headers"), lambda x: x["value"].cast("string"))
    return rows.select(
        h[0].alias("id"), "topic", F.col("key").cast("string").alias("key_text"),
        F.col("timestamp").alias("sent_at"), h[1].alias("h_type"), h[2].alias("h_source"),
        h[3].alias("h_traceparent"), h[4].alias("h_correlation"), F.size("headers").alias("n_headers"),
    )


@case("""
SELECT event_id,
  CASE WHEN cut THEN 'body_invalid' WHEN long THEN 'body_too_long'
       WHEN mistyped THEN 'body_invalid' ELSE 'ok' END AS status,
  CASE WHEN NOT (cut OR long OR mistyped) THEN b_stream END AS stream_id,
  CASE WHEN NOT (cut OR long OR mistyped) THEN b_type END AS type,
  CASE WHEN NOT (cut OR long OR mistyped) THEN '{"n": 1.10, "pad": "y", "type": "inner"}' END AS payload,
  CASE WHEN NOT (cut OR long OR mistyped) THEN region END AS region
FROM bodies""", fx.BODIES)
def request_decode(spark, sf_dir):
    ok, bad = decode_requests(fx.request_bodies(spark, sf_dir))
    fine = ok.select(
        "event_id", F.lit("ok").alias("status"), "stream_id", "type", "payload",
        F.col("metadata")["region"].alias("region"),
    )
    return fine.unionByName(
        bad.select("event_id", F.col("reject_reason").alias("status")), allowMissingColumns=True
    )


# ---------------------------------------------------------------- ingest


@case("""
SELECT event_id, CASE
    WHEN event_id % 61 = 0 THEN 'tenant_missing'
    WHEN event_id % 53 IN (0, 1, 2) THEN 'fields_missing'
    ELSE 'valid' END AS outcome
FROM base""")
def validate_split(spark, sf_dir):
    every = F.col("event_id")
    rows = fx.unversioned(spark, sf_dir).withColumns(
        {
            "tenant_id": F.when(every % 61 == 0, F.lit("")).otherwise(F.col("tenant_id")),
            "stream_id": F.when(every % 53 == 0, F.lit("")).otherwise(F.col("stream_id")),
            "type": F.when(every % 53 == 1, F.lit("")).otherwise(F.col("type")),
            "source": F.when(every % 53 == 2, F.lit(None)).otherwise(F.col("source")),
        }
    )
    valid, rejected = ingest.validate(rows)
    return valid.select("event_id", F.lit("valid").alias("outcome")).unionByName(
        rejected.select("event_id", F.col("reject_reason").alias("outcome"))
    )


@case("""
SELECT event_id, tenant_id, stream_id, CAST(0 AS BIGINT) AS version,
  CAST(CASE WHEN event_id % 4 = 3 THEN 3 ELSE 1 END AS INTEGER) AS event_version,
  CASE WHEN event_id % 3 = 0 THEN 'null' ELSE payload END AS payload,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS metadata_keys,
  CASE WHEN event_id % 7 = 0 THEN 36 ELSE length(correlation_id) END AS correlation_chars,
  CAST('2024-03-01 00:00:00' AS TIMESTAMP) AS occurred_at, '' AS source_version, false AS is_replay
FROM base""")
def normalise(spark, sf_dir):
    """Defaults for absent and empty fields."""
    every = F.col("event_id")
    rows = fx.unversioned(spark, sf_dir).select(
        "event_id", "tenant_id", "stream_id", "type", "source",
        F.when(every % 4 == 3, F.lit(3)).when(every % 4 == 2, F.lit(-1)).alias("event_version"),
        F.when(every % 3 != 0, F.col("payload")).alias("payload"),
        F.when(every % 5 != 0, F.col("metadata")).alias("metadata"),
        F.when(every % 7 == 0, F.lit("")).otherwise(F.col("correlation_id")).alias("correlation_id"),
    )
    done = ingest.normalise(rows, F.lit(fx.REPLAY_TIME).cast("timestamp"), id_from=[every])
    return done.select(
        "event_id", "tenant_id", "stream_id", "version", "event_version", "payload",
        F.size("metadata").alias("metadata_keys"),
        F.char_length("correlation_id").alias("correlation_chars"),
        "occurred_at", "source_version", "is_replay",
    )


@case("SELECT event_id, CASE WHEN user_id % 7 < 5 THEN 'tenant-of-' || CAST(user_id % 7 AS VARCHAR) END AS tenant_id FROM base")
def tenant_stamp(spark, sf_dir):
    """Tenants from a credential table that Spark derives from the same events."""
    rows = fx.unversioned(spark, sf_dir).withColumn(
        "credential", F.concat(F.lit("key-"), (F.col("user_id") % 7).cast("string"))
    )
    known = rows.filter("user_id % 7 < 5").select(
        "credential", F.concat(F.lit("tenant-of-"), (F.col("user_id") % 7).cast("string")).alias("tenant_id")
    )
    return ingest.stamp_tenants(rows, known).select("event_id", "tenant_id")


@case("""
SELECT id, CASE WHEN event_id % 3 = 0 THEN 'hdr-' || correlation_id ELSE 'req-' || CAST(event_id AS VARCHAR) END AS correlation_id,
  CASE WHEN event_id % 4 = 0 THEN 'cause-from-header' ELSE causation_id END AS causation_id,
  coalesce(tp_trace, CASE WHEN event_id % 2 = 0 THEN md5(id) END, trace_id) AS trace_id
FROM traced""", fx.HEADED)
def header_resolve(spark, sf_dir):
    rows = ingest.resolve_headers(fx.headed(spark, sf_dir))
    return rows.select("id", "correlation_id", "causation_id", "trace_id")


@case("SELECT id, stream_id, version FROM canonical")
def version_assign(spark, sf_dir):
    return fx.versioned(spark, sf_dir).select("id", "stream_id", "version")


_STORED = fx.CANONICAL + """,
stored AS (
  SELECT id, stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY occurred_at, id) AS version
  FROM base WHERE occurred_at < '2024-01-16'
),
tops AS (SELECT stream_id, max(version) AS top FROM stored GROUP BY stream_id),
fresh AS (
  SELECT id, coalesce(top, 0) + row_number() OVER (PARTITION BY b.stream_id ORDER BY occurred_at, id) AS version
  FROM base b LEFT JOIN tops t ON t.stream_id = b.stream_id WHERE occurred_at >= '2024-01-16'
)"""


@case("""
SELECT id, version, true AS is_new FROM fresh
UNION ALL
SELECT s.id, s.version, false FROM stored s JOIN base b USING (id) WHERE b.occurred_at >= '2024-01-10'""", _STORED)
def idempotent_append(spark, sf_dir):
    """I6 with I5: a batch that overlaps the log and delivers every row twice."""
    events = fx.unversioned(spark, sf_dir).select(*COLS)
    log = fx.assign_versions(events.filter("occurred_at < '2024-01-16'"))
    batch = events.filter("occurred_at >= '2024-01-10'")
    again = batch.withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 1 minute"))
    return append_result(batch.unionByName(again), log)


# ---------------------------------------------------------------- trace


@case("""
SELECT id, tp_trace IS NOT NULL AS ok, tp_trace AS trace_id,
  CASE WHEN tp_trace IS NOT NULL THEN split_part(traceparent, '-', 3) END AS parent_span_id,
  CASE WHEN tp_trace IS NOT NULL THEN split_part(traceparent, '-', 4) = '01' END AS sampled
FROM traced""", fx.HEADED)
def traceparent_parse(spark, sf_dir):
    parsed = parse_traceparent(F.col("headers")["traceparent"])
    rows = fx.headed(spark, sf_dir).select("id", parsed.alias("t"))
    return rows.select("id", F.col("t").isNotNull().alias("ok"), "t.trace_id", "t.parent_span_id", "t.sampled")


@case("""
SELECT id, coalesce(tp_trace, CASE WHEN event_id % 2 = 0 THEN md5(id) END) AS trace_id,
  length(coalesce(tp_trace, CASE WHEN event_id % 2 = 0 THEN md5(id) END, repeat('x', 32))) AS chars
FROM traced""", fx.HEADED)
def trace_resolve(spark, sf_dir):
    """I8; rows that get a random id show only its length."""
    h = F.col("headers")
    known = resolve_trace(h["traceparent"], h["x-trace-id"], F.lit(None).cast("string"))
    full = resolve_trace(h["traceparent"], h["x-trace-id"])
    return fx.headed(spark, sf_dir).select("id", known.alias("trace_id"), F.char_length(full).alias("chars"))


@case("""
SELECT id, '00-' || trace_id || '-' || substr(md5(id), 1, 16) || '-' || CASE WHEN event_id % 2 = 0 THEN '01' ELSE '00' END AS traceparent
FROM base""")
def traceparent_format(spark, sf_dir):
    rows = fx.unversioned(spark, sf_dir)
    text = format_traceparent(F.col("trace_id"), span_of(F.col("id")), F.col("event_id") % 2 == 0)
    return rows.select("id", text.alias("traceparent"))


@case("SELECT id, CASE WHEN event_id % 3 = 0 THEN 'hdr-' || correlation_id ELSE correlation_id END AS correlation_id FROM base")
def correlation_coalesce(spark, sf_dir):
    header = F.col("headers")["x-correlation-id"]
    return fx.headed(spark, sf_dir).select("id", coalesce_id(header, F.col("correlation_id")).alias("correlation_id"))


# ---------------------------------------------------------------- audit queries

EVENT_6 = "00000000-0000-4000-8000-000000000006"
EVENT_5 = "00000000-0000-4000-8000-000000000005"


def _page_sql(where: str, order: str, limit: int, offset: int, source: str = "canonical") -> str:
    return (
        f"SELECT {ROW_SQL}, region FROM {source} WHERE {where} "
        f"ORDER BY {order} LIMIT {limit} OFFSET {offset}"
    )


_NEWEST = "occurred_at DESC, id DESC"


@case(f"SELECT {ROW_SQL}, region FROM canonical WHERE id = '{EVENT_6}' AND tenant_id = '{TENANT}'")
def by_id(spark, sf_dir):
    return brief(q.by_id(fx.canonical(spark, sf_dir), TENANT, EVENT_6.upper()))


@case(f"SELECT id FROM base WHERE id = '{EVENT_6}' AND tenant_id = 'tenant-2'")
def by_id_other_tenant(spark, sf_dir):
    """Another tenant's event is not found."""
    return q.by_id(fx.unversioned(spark, sf_dir), "tenant-2", EVENT_6).select("id")


@case(f"SELECT id, tenant_id, stream_id FROM base WHERE tenant_id = '{TENANT}' AND type = 'user.click'")
def by_ids_semi(spark, sf_dir):
    """Ids of all clicks, any tenant, asked by one tenant."""
    log = fx.unversioned(spark, sf_dir)
    wanted = log.filter("type = 'user.click'").select(F.upper("id").alias("id"))
    return q.by_ids(log, TENANT, wanted).select("id", "tenant_id", "stream_id")


@case(f"SELECT {ROW_SQL}, region FROM canonical WHERE stream_id = 'view:7'")
def stream_full(spark, sf_dir):
    return brief(q.stream(fx.canonical(spark, sf_dir), "view:7"))


@case(f"SELECT {ROW_SQL}, region FROM canonical WHERE stream_id = 'view:7' AND tenant_id = '{TENANT}' AND version >= 5")
def from_version(spark, sf_dir):
    return brief(q.stream(fx.canonical(spark, sf_dir), "view:7", TENANT, from_version=5))


@case(_page_sql(f"tenant_id = '{TENANT}' AND stream_id = 'view:7'", "version, id", 5, 2))
def stream_page(spark, sf_dir):
    return brief(q.stream_page(fx.canonical(spark, sf_dir), TENANT, "view:7", 5, 2)[0])


@case(_page_sql(f"tenant_id = '{TENANT}'", _NEWEST, 20, 40))
def feed_page(spark, sf_dir):
    return brief(q.feed_page(fx.canonical(spark, sf_dir), TENANT, 0, 40)[0])


@case(_page_sql(f"tenant_id = '{TENANT}' AND correlation_id = 'corr-1'", _NEWEST, 20, 0))
def by_correlation(spark, sf_dir):
    return brief(q.by_correlation(fx.canonical(spark, sf_dir), TENANT, "corr-1")[0])


@case(_page_sql(f"tenant_id = '{TENANT}' AND causation_id = '{EVENT_5}'", "occurred_at, id", 20, 0))
def by_causation(spark, sf_dir):
    return brief(q.effects(fx.canonical(spark, sf_dir), TENANT, EVENT_5)[0])


@case("""
SELECT c.tenant_id, c.causation_id, c.id, c.stream_id, c.type, c.occurred_at,
  p.stream_id AS cause_stream_id, p.type AS cause_type, p.occurred_at AS cause_occurred_at
FROM base c JOIN base p ON c.causation_id = p.id AND c.tenant_id = p.tenant_id""")
def children_join(spark, sf_dir):
    return q.children(fx.unversioned(spark, sf_dir))


@case(_page_sql(f"tenant_id = '{TENANT}'", _NEWEST, 20, 0))
def timeline_page(spark, sf_dir):
    return brief(q.timeline(fx.canonical(spark, sf_dir), TENANT)[0])


_FROM, _TO = "2024-01-10 00:00:00", "2024-01-12 12:00:00"


@case(_page_sql(f"tenant_id = '{TENANT}' AND occurred_at >= '{_FROM}' AND occurred_at <= '{_TO}'", _NEWEST, 100, 10))
def timeline_window(spark, sf_dir):
    low, high = (F.lit(t).cast("timestamp") for t in (_FROM, _TO))
    return brief(q.timeline(fx.canonical(spark, sf_dir), TENANT, low, high, 9999, 10)[0])


@case(f"""
SELECT count(*) AS total, 100 AS "limit", 999999 AS "offset" FROM base
WHERE tenant_id = '{TENANT}' AND occurred_at >= '{_FROM}' AND occurred_at <= '{_TO}'""")
def page_total(spark, sf_dir):
    """The total stays right past the last page."""
    low, high = (F.lit(t).cast("timestamp") for t in (_FROM, _TO))
    return q.timeline(fx.unversioned(spark, sf_dir), TENANT, low, high, 500, 999_999)[1]


@case(f"""
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS place FROM canonical WHERE tenant_id = '{TENANT}')
SELECT {ROW_SQL}, region FROM numbered WHERE place > 150 AND place <= 200""".replace("WITH numbered AS", "SELECT * FROM (WITH numbered AS") + ")")
def deep_page(spark, sf_dir):
    """A page found by row numbers, the way of pages beyond the top-k depth."""
    rows = fx.canonical(spark, sf_dir).filter(F.col("tenant_id") == TENANT)
    numbered = paging.running_total(rows, ["tenant_id"], q.newest_first(), q._newest_digits(), name="place")
    return brief(numbered.filter(F.col("place").between(151, 200)))


@case(f"""
SELECT count(*) AS total, 20 AS "limit", 0 AS "offset", 'postgres' AS read_model, 'strong' AS consistency, 'correlation' AS asked
FROM base WHERE tenant_id = '{TENANT}' AND correlation_id = 'corr-1'
UNION ALL
SELECT count(*), 20, 0, 'elasticsearch', 'eventual', 'feed' FROM base WHERE tenant_id = '{TENANT}' AND event_id % 97 <> 0""")
def read_route(spark, sf_dir):
    log, index = fx.unversioned(spark, sf_dir), fx.projection(spark, sf_dir)
    strong = q.list_events(log, index, TENANT, "corr-1")[1].withColumn("asked", F.lit("correlation"))
    return strong.unionByName(q.list_events(log, index, TENANT)[1].withColumn("asked", F.lit("feed")))


@case(_page_sql(f"tenant_id = '{TENANT}' AND actor_id = 'user-7'", _NEWEST, 50, 0))
def actor_feed(spark, sf_dir):
    return brief(q.actor_feed(fx.canonical(spark, sf_dir), TENANT, "user-7", 50)[0])


@case("""
SELECT tenant_id, actor_id, count(*) AS events, count(DISTINCT type) AS types,
  min(occurred_at) AS first_at, max(occurred_at) AS last_at
FROM base GROUP BY tenant_id, actor_id""")
def actor_summary(spark, sf_dir):
    return q.actor_summary(fx.unversioned(spark, sf_dir))


@case("SELECT id, stream_id, version, replay_source_event_id FROM whole WHERE tenant_id = 'tenant-1' AND replay_id = 'replay-1'", fx.REPLAYED)
def replay_batch_feed(spark, sf_dir):
    rows = q.replay_batch(fx.with_replays(spark, sf_dir), TENANT, fx.REPLAY_ID)
    return rows.select("id", "stream_id", "version", "replay_source_event_id")


@case(f"SELECT id, stream_id, version, occurred_at FROM whole WHERE is_replay AND tenant_id = '{TENANT}' ORDER BY {_NEWEST} LIMIT 20", fx.REPLAYED)
def replay_feed(spark, sf_dir):
    rows, _ = q.replay_feed(fx.with_replays(spark, sf_dir), TENANT)
    return rows.select("id", "stream_id", "version", "occurred_at")


@case("""
SELECT request_id, CASE WHEN bad_from THEN 'from_time_bad'
  WHEN bad_to THEN 'to_time_bad' ELSE 'ok' END AS outcome,
  CASE WHEN NOT bad_from AND NOT bad_to THEN from_at END AS from_at,
  CASE WHEN NOT bad_from AND NOT bad_to THEN to_at END AS to_at
FROM timed""", fx.TIMELINE_REQUESTS)
def request_bounds(spark, sf_dir):
    ok, bad = rt.parse_bounds(fx.timeline_requests(spark, sf_dir))
    return ok.select("request_id", F.lit("ok").alias("outcome"), "from_at", "to_at").unionByName(
        bad.select("request_id", F.col("reject_reason").alias("outcome")), allowMissingColumns=True
    )


_MATCHED = fx.TIMELINE_REQUESTS + """,
good AS (SELECT * FROM timed WHERE NOT bad_from AND NOT bad_to),
paired AS (
  SELECT request_id, g.tenant_id, n, skip, b.id,
    row_number() OVER (PARTITION BY request_id ORDER BY b.occurred_at DESC, b.id DESC) AS rn,
    count(*) OVER (PARTITION BY request_id) AS total
  FROM good g JOIN base b ON g.tenant_id = b.tenant_id
    AND (from_at IS NULL OR b.occurred_at >= from_at) AND (to_at IS NULL OR b.occurred_at <= to_at)
)"""


@case("""
SELECT g.request_id, g.tenant_id, coalesce(max(p.total), 0) AS total
FROM good g LEFT JOIN paired p USING (request_id) GROUP BY g.request_id, g.tenant_id""", _MATCHED)
def timeline_totals(spark, sf_dir):
    ok, _ = rt.parse_bounds(fx.timeline_requests(spark, sf_dir))
    return rt.timeline_totals(fx.unversioned(spark, sf_dir), ok)


@case("SELECT request_id, tenant_id, rn - skip AS place, id, total FROM paired WHERE rn > skip AND rn <= skip + n", _MATCHED)
def timeline_pages(spark, sf_dir):
    ok, _ = rt.parse_bounds(fx.timeline_requests(spark, sf_dir))
    return rt.timeline_pages(fx.unversioned(spark, sf_dir), ok)


# ---------------------------------------------------------------- replay

_WANTED = replay.ReplayFilter(tenant_id=TENANT, event_type="user.error")


@case("SELECT id, stream_id, occurred_at FROM base WHERE tenant_id = 'tenant-1' AND type = 'user.error'")
def replay_match(spark, sf_dir):
    return replay.match(fx.unversioned(spark, sf_dir), _WANTED).select("id", "stream_id", "occurred_at")


@case("SELECT id, stream_id FROM base WHERE tenant_id = 'tenant-1' AND user_id % 3 = 1")
def replay_match_ids(spark, sf_dir):
    """Ids beat the other fields: the stream named here is ignored."""
    log = fx.unversioned(spark, sf_dir)
    ids = log.filter("user_id % 3 = 1").select("id")
    wanted = replay.ReplayFilter(tenant_id=TENANT, stream_id="none:0", event_ids=ids)
    return replay.match(log, wanted).select("id", "stream_id")


@case("""
SELECT request_id, coalesce(reject_reason, 'ok') AS outcome,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN asked_tenant = '' THEN caller_tenant ELSE asked_tenant END END AS tenant_id,
  CASE WHEN reject_reason IS NULL THEN safety_limit END AS safety_limit
FROM judged""", fx.REPLAY_REQUESTS)
def replay_request_rules(spark, sf_dir):
    ok, bad = rt.validate_requests(fx.replay_requests(spark, sf_dir))
    return ok.select("request_id", F.lit("ok").alias("outcome"), "tenant_id", "safety_limit").unionByName(
        bad.select("request_id", F.col("reject_reason").alias("outcome")), allowMissingColumns=True
    )


@case("""
SELECT request_id, tenant_id, matched_count, CASE WHEN matched_count > safety_limit THEN 'limit_exceeded' ELSE 'ok' END AS status
FROM counted""", fx.REPLAY_REQUESTS)
def replay_request_counts(spark, sf_dir):
    """R5 for a table of requests: who is over its safety limit."""
    ok, _ = rt.validate_requests(fx.replay_requests(spark, sf_dir))
    return rt.match_requests(fx.unversioned(spark, sf_dir), ok)[0]


@case("""
SELECT h.request_id, h.tenant_id, h.id FROM hits h JOIN counted c USING (request_id) WHERE matched_count <= safety_limit""", fx.REPLAY_REQUESTS)
def replay_request_matches(spark, sf_dir):
    ok, _ = rt.validate_requests(fx.replay_requests(spark, sf_dir))
    return rt.match_requests(fx.unversioned(spark, sf_dir), ok)[1]


def _request(dry_run: bool) -> replay.ReplayRequest:
    import datetime as dt

    return replay.ReplayRequest(
        filter=_WANTED, caller_tenant=TENANT, dry_run=dry_run, replay_reason=fx.REPLAY_REASON,
        safety_limit=2**31 - 2, replay_id=fx.REPLAY_ID,
        now=dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc),
    )


@case("""
SELECT id, stream_id, version, occurred_at FROM canonical WHERE tenant_id = 'tenant-1' AND type = 'user.error'""")
def replay_dry_run(spark, sf_dir):
    _, events = jobs.execute(fx.canonical(spark, sf_dir), _request(True))
    return events.select("id", "stream_id", "version", "occurred_at")


@case("""
SELECT id, tenant_id, stream_id, type, version, event_version, occurred_at, payload, correlation_id, causation_id,
  actor_id, trace_id, true AS is_replay, 'replay-1' AS replay_id, CAST('2024-03-01 00:00:00' AS TIMESTAMP) AS replayed_at,
  'consumer was down' AS replay_reason, source_id AS replay_source_event_id
FROM replayed""", fx.REPLAYED)
def replay_rows(spark, sf_dir):
    _, events = jobs.execute(fx.canonical(spark, sf_dir), _request(False))
    return events.drop("metadata", "source", "source_version")


@case("""
SELECT id, region, 'true' AS m_is_replay, 'replay-1' AS m_replay_id, source_id AS m_source, 'consumer was down' AS m_reason, 5 AS keys
FROM replayed""", fx.REPLAYED)
def replay_metadata(spark, sf_dir):
    m = F.col("metadata")
    return fx.replayed(fx.canonical(spark, sf_dir)).select(
        "id", m["region"].alias("region"), m["is_replay"].alias("m_is_replay"), m["replay_id"].alias("m_replay_id"),
        m["replay_source_event_id"].alias("m_source"), m["replay_reason"].alias("m_reason"), F.size(m).alias("keys"),
    )


@case("""
SELECT 'replay-1' AS replay_id, false AS dry_run, count(*) AS matched_count, count(*) AS replayed_count
FROM base WHERE tenant_id = 'tenant-1' AND type = 'user.error'
UNION ALL
SELECT '', true, count(*), 0 FROM base WHERE tenant_id = 'tenant-1' AND type = 'user.error'""")
def replay_summary(spark, sf_dir):
    log = fx.unversioned(spark, sf_dir).select(*COLS)
    active, _ = jobs.execute(log, _request(False))
    dry, _ = jobs.execute(log, _request(True))
    return active.unionByName(dry)


@case(f"""
SELECT id, {_TOPIC} AS topic, stream_id AS key_text, CAST('2024-03-01 00:00:00' AS TIMESTAMP) AS sent_at, 'replay-1' AS replay_id
FROM replayed""", fx.REPLAYED)
def replay_publish(spark, sf_dir):
    """Bus messages of the replayed rows."""
    rows = to_messages(fx.replayed(fx.canonical(spark, sf_dir)), fx.ROUTES, fx.FALLBACK)
    text = F.col("value").cast("string")
    return rows.select(
        F.get_json_object(text, "$.id").alias("id"), "topic", F.col("key").cast("string").alias("key_text"),
        F.col("timestamp").alias("sent_at"), F.get_json_object(text, "$.metadata.replay_id").alias("replay_id"),
    )


@case("""
SELECT date_trunc('hour', occurred_at) AS from_time, date_trunc('hour', occurred_at) + INTERVAL 1 HOUR AS until_time, count(*) AS events
FROM base WHERE tenant_id = 'tenant-1' GROUP BY 1, 2""")
def replay_plan_hourly(spark, sf_dir):
    wanted = replay.ReplayFilter(tenant_id=TENANT)
    return replay.plan_hourly(replay.match(fx.unversioned(spark, sf_dir), wanted))


@case("""
SELECT id, stream_id, type FROM base WHERE event_id % 31 = 0 AND event_id % 41 <> 0 AND tenant_id = 'tenant-1'""")
def dlq_recover(spark, sf_dir):
    """Dead-lettered events of a tenant, found again in the log."""
    refused = decode_messages(fx.bus_messages(spark, sf_dir))[0].filter(index_error().isNotNull())
    dlq = to_dlq(refused, index_error(), F.lit(fx.REPLAY_TIME).cast("timestamp"))
    wanted = replay.filter_from_dlq(dlq, TENANT)
    return replay.match(fx.unversioned(spark, sf_dir), wanted).select("id", "stream_id", "type")


# ---------------------------------------------------------------- routing, projection


@case(f"SELECT id, {_TOPIC} AS topic, split_part(stream_id, ':', 1) AS prefix FROM base")
def topic_route(spark, sf_dir):
    rows = fx.unversioned(spark, sf_dir)
    topic = topic_column(F.col("stream_id"), fx.ROUTES, fx.FALLBACK)
    return rows.select("id", topic.alias("topic"), stream_prefix(F.col("stream_id")).alias("prefix"))


@case("""
SELECT id, CASE split_part(stream_id, ':', 1) WHEN 'order' THEN 'events.order.v2' WHEN 'user' THEN 'events.user.v2'
  WHEN 'view' THEN 'events.view.v2' ELSE 'events.v1' END AS topic FROM base""")
def topic_route_table(spark, sf_dir):
    """Routes as a table derived from the log, each prefix given twice: the last wins."""
    log = fx.unversioned(spark, sf_dir)
    prefixes = log.select(stream_prefix(F.col("stream_id")).alias("prefix")).distinct().filter(
        F.col("prefix").isin("order", "user", "view")
    )
    routes = prefixes.select(
        "prefix", F.explode(F.array(F.lit(1), F.lit(2))).alias("position")
    ).withColumn("topic", F.concat(F.lit("events."), "prefix", F.lit(".v"), F.col("position").cast("string")))
    return route_by_table(log, routes, fx.FALLBACK).select("id", "topic")


@case(f"SELECT {_TOPIC} AS topic, count(*) AS messages, count(DISTINCT stream_id) AS streams FROM base GROUP BY 1")
def topic_counts(spark, sf_dir):
    rows = to_messages(fx.unversioned(spark, sf_dir), fx.ROUTES, fx.FALLBACK)
    return rows.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("key").alias("streams")
    )


@case("SELECT id, stream_id, version FROM canonical")
def bus_order(spark, sf_dir):
    """Rows as exported, each stream in version order."""
    return order_for_export(fx.versioned(spark, sf_dir)).select("id", "stream_id", "version")


@case("""
SELECT id, topic, pos AS "offset", trace_id, correlation_id FROM sent""", fx.SENT)
def header_extract(spark, sf_dir):
    """Trace and correlation from message headers, for good and bad messages."""
    rows = fx.bus_messages(spark, sf_dir).withColumn("c", message_context(F.col("headers")))
    ident = F.filter("headers", lambda h: h["key"] == "event_id")[0]["value"].cast("string")
    return rows.select(ident.alias("id"), "topic", "offset", "c.trace_id", "c.correlation_id")


@case("""
SELECT topic, CAST(user_id % 6 AS INTEGER) AS "partition", pos AS "offset", stream_id AS key, trace_id, correlation_id,
  'not a JSON object' AS error
FROM sent WHERE broken""", fx.SENT)
def quarantine(spark, sf_dir):
    """Undecodable messages with their position and header context."""
    bad = decode_messages(fx.bus_messages(spark, sf_dir))[1]
    return bad.drop("preview")


@case("""
SELECT id, pos AS "offset", CASE WHEN scalar THEN 'payload is not an object' ELSE 'indexed' END AS outcome
FROM sent WHERE NOT broken""", fx.SENT)
def dlq_split(spark, sf_dir):
    """Which deliveries are indexed and which are dead-lettered."""
    ok = decode_messages(fx.bus_messages(spark, sf_dir))[0]
    return ok.select("id", "offset", F.coalesce(index_error(), F.lit("indexed")).alias("outcome"))


@case("""
SELECT id, stream_id, correlation_id, 'payload is not an object' AS reason, '42' AS payload,
  CAST('2024-03-01 00:00:00' AS TIMESTAMP) AS failed_at
FROM sent WHERE NOT broken AND scalar""", fx.SENT)
def dlq_envelope(spark, sf_dir):
    """C4: dead-letter envelopes."""
    refused = decode_messages(fx.bus_messages(spark, sf_dir))[0].filter(index_error().isNotNull())
    dlq = to_dlq(
        refused, index_error(), F.lit(fx.REPLAY_TIME).cast("timestamp"), F.col("context.correlation_id")
    )
    return dlq.select("event.id", "event.stream_id", "correlation_id", "reason", "event.payload", "failed_at")


@case("""
SELECT id, stream_id, version, CAST(max(sent_version) AS INTEGER) AS event_version, max(pos) AS "offset", count(*) > 0 AS present
FROM sent WHERE NOT broken AND NOT scalar GROUP BY id, stream_id, version""", fx.SENT)
def projection_latest(spark, sf_dir):
    """One document per id, the last delivery wins."""
    ok = decode_messages(fx.bus_messages(spark, sf_dir))[0].filter(index_error().isNull())
    latest = latest_by_id(cut_lineage(ok.select(*COLS, *POSITION)), POSITION)  # decoded once
    return latest.select("id", "stream_id", "version", "event_version", "offset", F.lit(True).alias("present"))


@case("""
SELECT event_id, event_id % 4 IN (0, 1, 3) AS fits FROM base""")
def indexable_payloads(spark, sf_dir):
    """Objects, arrays of objects and null fit; scalars and arrays of scalars do not."""
    turn = F.col("event_id") % 4
    payload = (
        F.when(turn == 0, F.lit("null"))
        .when(turn == 1, F.concat(F.lit("[ "), "payload", F.lit("]")))
        .when((turn == 2) & (F.col("user_id") % 2 == 0), F.to_json(F.array("stream_id", "type")))
        .when(turn == 2, F.concat(F.lit('"'), "stream_id", F.lit('"')))
        .otherwise(F.concat(F.lit("  "), "payload"))
    )
    return fx.unversioned(spark, sf_dir).select("event_id", indexable(payload).alias("fits"))


# ---------------------------------------------------------------- audits


@case("""
SELECT stream_id, min(version) AS first_version, max(version) AS last_version, count(*) AS events,
  count(DISTINCT version) AS distinct_versions,
  max(version) - min(version) + 1 = count(*) AND count(*) = count(DISTINCT version) AS contiguous
FROM gapped GROUP BY stream_id""", fx.GAPPED)
def gap_fast(spark, sf_dir):
    return audit.gap_check(fx.with_gaps(spark, sf_dir))


_LAG = """
SELECT {keys}, prev AS previous_version, prev + 1 AS missing_version, version AS found_version, count(*) AS times
FROM (SELECT {keys}, version, lag(version) OVER (PARTITION BY {keys} ORDER BY version) AS prev FROM {source})
WHERE version <> prev + 1 GROUP BY ALL"""


@case(_LAG.format(keys="stream_id", source="gapped"), fx.GAPPED)
def gap_locate(spark, sf_dir):
    return audit.gaps(fx.with_gaps(spark, sf_dir))


@case(_LAG.format(keys="tenant_id, stream_id", source="canonical"))
def gap_by_tenant(spark, sf_dir):
    """Gaps a tenant sees in streams it shares with others."""
    return audit.gaps(fx.versioned(spark, sf_dir), ["tenant_id", "stream_id"])


@case("""
SELECT stream_id, version, id FROM gapped g WHERE version BETWEEN 2 AND 6 AND NOT EXISTS (
  SELECT 1 FROM (SELECT stream_id, version, lag(version) OVER (PARTITION BY stream_id ORDER BY version) AS prev
                 FROM gapped WHERE version BETWEEN 2 AND 6) p
  WHERE p.stream_id = g.stream_id AND p.version <> p.prev + 1)""", fx.GAPPED)
def replay_read_all(spark, sf_dir):
    """R2, R3 for every stream: versions 2 to 6, streams without a gap in that range."""
    rows = fx.with_gaps(spark, sf_dir).filter(F.col("version").between(2, 6))
    broken = audit.gaps(rows).select("stream_id").distinct()
    return rows.join(broken, "stream_id", "left_anti").select("stream_id", "version", "id")


@case("""
SELECT request_id, coalesce(refused, CASE WHEN gap IS NOT NULL THEN 'version_gap' END) AS reject_reason,
  gap['p'] AS previous_version, gap['p'] + 1 AS missing_version, gap['f'] AS found_version
FROM requests LEFT JOIN broken USING (request_id)""", fx.RANGES)
def range_read_verdicts(spark, sf_dir):
    """Six range reads for every stream, all rejects named with their first gap."""
    return runs.read_ranges(fx.with_gaps(spark, sf_dir), fx.range_requests(spark, sf_dir), width=4)[0]


@case("""
SELECT request_id, id, version FROM found WHERE request_id NOT IN (SELECT request_id FROM broken)""", fx.RANGES)
def range_read_rows(spark, sf_dir):
    """The rows of the range reads that are contiguous."""
    rows = runs.read_ranges(fx.with_gaps(spark, sf_dir), fx.range_requests(spark, sf_dir))[1]
    return rows.select("request_id", "id", "version")


@case("""
SELECT tenant_id, stream_id, min(version) AS first, max(version) AS last FROM (
  SELECT *, sum(CASE WHEN version = previous + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id, stream_id ORDER BY version, n) AS run
  FROM (
    SELECT *, lag(version) OVER (PARTITION BY tenant_id, stream_id ORDER BY version, n) AS previous
    FROM (SELECT tenant_id, stream_id, version, row_number() OVER (PARTITION BY tenant_id, stream_id, version) AS n FROM gapped)
  )
) GROUP BY tenant_id, stream_id, run""", fx.GAPPED)
def version_runs(spark, sf_dir):
    """The runs of every stream; ranges of 3 versions, so that most runs cross borders."""
    return runs.version_runs(fx.with_gaps(spark, sf_dir), width=3)


@case("""
SELECT r.tenant_id, r.id, r.stream_id, r.version, r.replay_id, r.replay_source_event_id
FROM whole r WHERE r.is_replay AND NOT EXISTS (
  SELECT 1 FROM whole s WHERE s.id = r.replay_source_event_id AND s.tenant_id = r.tenant_id
    AND NOT (s.stream_id LIKE 'error:%' AND s.version <= 2 AND NOT s.is_replay))""", fx.REPLAYED)
def lineage_orphans(spark, sf_dir):
    """The log has lost the first two versions of the replayed streams."""
    whole = fx.with_replays(spark, sf_dir)
    lost = F.col("stream_id").startswith("error:") & (F.col("version") <= 2) & ~F.col("is_replay")
    return audit.lineage_orphans(whole.filter(~lost))


@case("""
SELECT tenant_id, id, stream_id, version, 'lost-' || CAST(event_id % 5 AS VARCHAR) AS causation_id
FROM canonical WHERE event_id % 89 = 3""")
def causation_orphans(spark, sf_dir):
    return audit.causation_orphans(fx.with_orphans(spark, sf_dir))


@case("""
SELECT tenant_id, id, '00000000-0000-4000-8000-' || lpad(CAST(event_id // 5 * 5 AS VARCHAR), 12, '0') AS root_id,
  CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS depth
FROM base""")
def causation_roots(spark, sf_dir):
    """A1 for all events at once, by pointer doubling."""
    return causation.causation_roots(fx.unversioned(spark, sf_dir))


_TREE = fx.CANONICAL.replace("base AS (", "RECURSIVE base AS (", 1) + """,
tree AS (
  SELECT tenant_id, id AS root_id, id, causation_id, 0 AS depth FROM base WHERE type = 'user.purchase'
  UNION ALL
  SELECT b.tenant_id, t.root_id, b.id, b.causation_id, t.depth + 1
  FROM tree t JOIN base b ON b.causation_id = t.id AND b.tenant_id = t.tenant_id
)"""


@case("SELECT * FROM tree", _TREE)
def causation_tree(spark, sf_dir):
    """A1 from given roots: everything each purchase caused."""
    log = fx.unversioned(spark, sf_dir)
    roots = log.filter("type = 'user.purchase'").select("tenant_id", "id")
    return causation.causation_tree(log, roots)


_INCIDENT = f"""
, seeds AS (
  SELECT id, 1 AS why FROM base WHERE tenant_id = '{TENANT}' AND correlation_id = 'corr-1'
  UNION ALL
  SELECT id, 2 FROM base WHERE tenant_id = '{TENANT}' AND occurred_at >= '{_FROM}' AND occurred_at <= '{_TO}'
),
reach AS (
  SELECT id, 3 AS why FROM seeds
  UNION
  SELECT b.id, 3 FROM reach r JOIN base b ON b.causation_id = r.id AND b.tenant_id = '{TENANT}'
)
SELECT id, stream_id, occurred_at, CASE min(why) WHEN 1 THEN 'correlation' WHEN 2 THEN 'window' ELSE 'causation' END AS via
FROM (SELECT * FROM seeds UNION ALL SELECT * FROM reach) JOIN base USING (id) GROUP BY id, stream_id, occurred_at"""


@case(_INCIDENT, fx.CANONICAL.replace("base AS (", "RECURSIVE base AS (", 1))
def incident(spark, sf_dir):
    low, high = (F.lit(t).cast("timestamp") for t in (_FROM, _TO))
    rows = causation.incident(fx.unversioned(spark, sf_dir), TENANT, "corr-1", low, high)
    return rows.select("id", "stream_id", "occurred_at", "via")


@case("""
SELECT l.trace_id, l.service, l.msg, t.events, t.tenant_id, t.first_at, t.last_at
FROM (SELECT trace_id, CASE WHEN event_id % 2 = 0 THEN 'workflow' ELSE 'saas' END AS service,
        'handled ' || CAST(event_id AS VARCHAR) AS msg FROM base WHERE (event_id // 5) % 3 = 0) l
JOIN (SELECT trace_id, count(*) AS events, min(tenant_id) AS tenant_id, min(occurred_at) AS first_at, max(occurred_at) AS last_at
      FROM base GROUP BY trace_id) t USING (trace_id)""")
def log_correlation(spark, sf_dir):
    """A3: each service log line with its trace's events."""
    return audit.correlate_logs(fx.unversioned(spark, sf_dir), fx.service_logs(spark, sf_dir))


@case("""
SELECT id, tenant_id, stream_id, type, occurred_at FROM base WHERE tenant_id = 'tenant-1' AND event_id % 97 = 0""")
def index_missing_all(spark, sf_dir):
    """A7 without a row limit."""
    return audit.index_missing(fx.unversioned(spark, sf_dir), fx.projection(spark, sf_dir), TENANT, limit=None)


@case("""
SELECT id, tenant_id, stream_id, type, occurred_at FROM base
WHERE tenant_id = 'tenant-1' AND event_id % 97 = 0 AND occurred_at >= '2024-01-05' ORDER BY occurred_at DESC, id DESC LIMIT 100""")
def index_missing(spark, sf_dir):
    low = F.lit("2024-01-05").cast("timestamp")
    return audit.index_missing(fx.unversioned(spark, sf_dir), fx.projection(spark, sf_dir), TENANT, low, limit=100)


@case("""
SELECT CASE WHEN event_id % 97 = 0 THEN 'missing' ELSE 'extra' END AS side, tenant_id, id, stream_id, type, occurred_at
FROM base WHERE (event_id % 97 = 0) <> (event_id % 193 = 5)""")
def reconcile_by_digest(spark, sf_dir):
    """What log and read model lack of each other, found by digests of hours."""
    log = fx.unversioned(spark, sf_dir).filter("event_id % 193 <> 5")
    return reconcile.reconcile(log, fx.projection(spark, sf_dir))


@case("""
SELECT tenant_id, CAST(floor(epoch(occurred_at) / 3600) AS BIGINT) AS hour FROM base
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_id % 97 = 0) > 0""")
def differing_hours(spark, sf_dir):
    """The hours whose digests differ, the log's merged from those of two batches."""
    log = fx.unversioned(spark, sf_dir)
    parts = [reconcile.hour_digests(log.filter(f"event_id % 2 = {i}")) for i in (0, 1)]
    return reconcile.differing_hours(
        reconcile.merge_digests(parts[0].union(parts[1])), reconcile.hour_digests(fx.projection(spark, sf_dir))
    )


@case("""
SELECT 'tenant-1' AS tenant_id, replay_id, count(*) AS replayed_count, count(DISTINCT replay_source_event_id) AS source_count,
  count(*) = count(DISTINCT replay_source_event_id) AS one_per_source
FROM whole WHERE is_replay GROUP BY replay_id""", fx.REPLAYED)
def replay_verify(spark, sf_dir):
    return audit.replay_verify(fx.with_replays(spark, sf_dir))


@case("""
SELECT id, 'default' AS tenant_id, stream_id, version, CAST(1 AS INTEGER) AS event_version, '' AS correlation_id, '' AS causation_id,
  '' AS actor_id, false AS is_replay, CAST(NULL AS TIMESTAMP) AS replayed_at, region, occurred_at
FROM canonical""")
def upcast(spark, sf_dir):
    """Rows that have only the first table version's columns."""
    old = fx.canonical(spark, sf_dir).select(
        "id", "stream_id", "type", "source", "version", "occurred_at", "payload", "metadata"
    )
    return audit.upcast(old).select(
        "id", "tenant_id", "stream_id", "version", "event_version", "correlation_id", "causation_id",
        "actor_id", "is_replay", "replayed_at", F.col("metadata")["region"].alias("region"), "occurred_at",
    )


@case("""
SELECT tenant_id, correlation_id, count(*) AS events, count(DISTINCT stream_id) AS streams,
  min(occurred_at) AS first_at, max(occurred_at) AS last_at
FROM base GROUP BY tenant_id, correlation_id""")
def correlation_profile(spark, sf_dir):
    return audit.correlation_profile(fx.unversioned(spark, sf_dir))


@case("""
SELECT correlation_id, count(DISTINCT tenant_id) AS tenants, count(*) AS events FROM (
  SELECT 'day-' || CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS correlation_id, tenant_id FROM base)
GROUP BY correlation_id HAVING count(DISTINCT tenant_id) > 1""")
def correlation_tenants(spark, sf_dir):
    """Correlation ids shared by tenants (here: one id per day)."""
    day = F.concat(F.lit("day-"), F.to_date("occurred_at").cast("string"))
    return audit.correlation_tenants(fx.unversioned(spark, sf_dir).withColumn("correlation_id", day))


@case(f"SELECT id, {_TIME} AS at FROM base")
def rfc3339_text(spark, sf_dir):
    return fx.unversioned(spark, sf_dir).select("id", rfc3339(F.col("occurred_at")).alias("at"))


# ---------------------------------------------------------------- stored tables and streams


def drain(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@case("""
SELECT id, tenant_id, stream_id, version, occurred_at, region, top AS head FROM canonical
JOIN (SELECT stream_id, max(version) AS top FROM canonical GROUP BY stream_id) USING (stream_id)""")
def log_append(spark, sf_dir):
    """The log stored in two overlapping batches, then read back."""
    path = run_dir(spark, "log")
    events = fx.unversioned(spark, sf_dir).select(*COLS)
    append_batch(events.filter("occurred_at < '2024-01-16'"), path, 0, writer="loader")
    append_batch(events.filter("occurred_at >= '2024-01-10'"), path, 1, writer="loader")
    heads = read_heads(spark, path).withColumnRenamed("version", "head")
    return (
        read_log(spark, path)
        .join(heads, "stream_id")
        .select("id", "tenant_id", "stream_id", "version", "occurred_at", F.col("metadata")["region"].alias("region"), "head")
    )


@case("""
SELECT b_stream AS stream_id, count(*) AS events, CAST(1 AS BIGINT) AS first_version, count(*) AS last_version, true AS contiguous
FROM bodies WHERE NOT (cut OR long OR mistyped) AND b_stream <> '' AND b_type <> '' GROUP BY b_stream
UNION ALL
SELECT 'rejected', count(*), 0, 0, false FROM bodies WHERE cut OR long OR mistyped OR b_stream = '' OR b_type = ''""", fx.BODIES)
def stream_ingest(spark, sf_dir):
    """S10, I1 to I6 and S2 as a stream over files of request bodies, drained twice."""
    home = run_dir(spark, "ingest")
    bodies = fx.request_bodies(spark, sf_dir).select("value")
    bodies.repartition(4, "value").write.text(f"{home}/in")
    for _ in range(2):
        drain(run_ingest(spark, f"{home}/in", f"{home}/log", f"{home}/rejected", TENANT, f"{home}/checkpoint"))
    per_stream = audit.gap_check(read_log(spark, f"{home}/log")).drop("distinct_versions")
    rejected = spark.read.parquet(f"{home}/rejected").agg(F.count(F.lit(1)).alias("events")).select(
        F.lit("rejected").alias("stream_id"), "events", F.lit(0).cast("bigint").alias("first_version"),
        F.lit(0).cast("bigint").alias("last_version"), F.lit(False).alias("contiguous"),
    )
    return per_stream.unionByName(rejected)


@case("""
SELECT 'indexed' AS outcome, id AS ref, CAST(max(sent_version) AS INTEGER) AS event_version
FROM sent WHERE NOT broken AND NOT scalar GROUP BY id
UNION ALL SELECT 'dead letter', id, sent_version FROM sent WHERE NOT broken AND scalar
UNION ALL SELECT 'quarantine', topic || '/' || CAST(user_id % 6 AS VARCHAR) || '/' || CAST(pos AS VARCHAR), 0 FROM sent WHERE broken""", fx.SENT)
def stream_projection(spark, sf_dir):
    """S4 to S6, C1 to C8 as a stream: originals first, redeliveries in later batches,
    drained twice on one checkpoint."""
    home = run_dir(spark, "projection")
    sent = fx.bus_messages(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE_SCHEMA])
    for part in (sent.filter(f"offset < {10**9}"), sent.filter(f"offset >= {10**9}")):
        part.repartition(4, "key").write.mode("append").parquet(f"{home}/bus")
    paths = ProjectionPaths(f"{home}/index", f"{home}/dlq", f"{home}/quarantine")
    options = {"path": f"{home}/bus", "maxFilesPerTrigger": "4"}
    for _ in range(2):
        drain(run_projection(read_messages(spark, "parquet", options), paths, f"{home}/checkpoint"))
    indexed = read_projection(spark, paths.projection).select(
        F.lit("indexed").alias("outcome"), F.col("id").alias("ref"), "event_version"
    )
    dead = spark.read.parquet(paths.dlq).select(
        F.lit("dead letter").alias("outcome"), F.col("event.id").alias("ref"), F.col("event.event_version").alias("event_version")
    )
    lost = spark.read.parquet(paths.quarantine).select(
        F.lit("quarantine").alias("outcome"), F.concat_ws("/", "topic", "partition", "offset").alias("ref"), F.lit(0).alias("event_version")
    )
    return indexed.unionByName(dead).unionByName(lost)


@case("SELECT id, stream_id, version FROM canonical")
def stream_log_projection(spark, sf_dir):
    """C11: the stored log projected as it grows."""
    home = run_dir(spark, "fan-out")
    paths = ProjectionPaths(f"{home}/index", f"{home}/dlq", f"{home}/quarantine")
    events = fx.unversioned(spark, sf_dir).select(*COLS)
    for batch_id, part in enumerate((events.filter("occurred_at < '2024-01-16'"), events)):
        append_batch(part, f"{home}/log", batch_id, writer="loader")
        drain(run_log_projection(spark, f"{home}/log", paths, f"{home}/checkpoint"))
    return read_projection(spark, paths.projection).select("id", "stream_id", "version")


_LIVE = fx.CANONICAL + """,
live AS (
  SELECT id AS source_id, stream_id, false AS is_replay, occurred_at, CASE WHEN occurred_at < '2024-01-16' THEN 0 ELSE 2 END AS phase FROM base
  UNION ALL
  SELECT id, stream_id, true, occurred_at, 1 FROM base WHERE tenant_id = 'tenant-1' AND type = 'user.error' AND occurred_at < '2024-01-16'
)"""


def _sources(log):
    source = F.when(F.col("is_replay"), F.col("replay_source_event_id")).otherwise(F.col("id"))
    return log.select(source.alias("source_id"), "stream_id", "is_replay", "version")


@case("""
SELECT source_id, stream_id, is_replay, row_number() OVER (PARTITION BY stream_id ORDER BY phase, occurred_at, source_id) AS version
FROM live""", _LIVE)
def replay_into_live_log(spark, sf_dir):
    """Two writers and a replay take turns on one stored log; the replay's own
    number is far ahead, and every writer begins to count at 0."""
    path = run_dir(spark, "live")
    events = fx.unversioned(spark, sf_dir).select(*COLS)
    append_batch(events.filter("occurred_at < '2024-01-16'"), path, 0, writer="first")
    jobs.run_replay(spark, path, _request(False), 1000)
    append_batch(events.filter("occurred_at >= '2024-01-16'"), path, 0, writer="second")
    return _sources(read_log(spark, path))


@case("""
SELECT source_id, stream_id, is_replay, row_number() OVER (PARTITION BY stream_id ORDER BY phase, occurred_at, source_id) AS version
FROM live""", _LIVE)
def replay_retry(spark, sf_dir):
    """The same replay before and after other batches, under other numbers, adds nothing."""
    path = run_dir(spark, "retry")
    events = fx.unversioned(spark, sf_dir).select(*COLS)
    append_batch(events.filter("occurred_at < '2024-01-16'"), path, 0, writer="loader")
    for batch_id in (1, 2):
        jobs.run_replay(spark, path, _request(False), batch_id)
    append_batch(events, path, 1, writer="loader")
    jobs.run_replay(spark, path, _request(False), 9)
    return _sources(read_log(spark, path))


@case("""
SELECT id, version FROM canonical WHERE tenant_id = 'tenant-1' AND occurred_at BETWEEN '2024-01-10 05:00:00' AND '2024-01-12 20:00:00'""")
def stored_timeline(spark, sf_dir):
    """A window of the stored log, read in another zone than it was written in."""
    path = run_dir(spark, "zones")
    append_batch(fx.unversioned(spark, sf_dir).select(*COLS), path, 0, writer="loader")
    low, high = (F.lit(f"{t}+00:00").cast("timestamp") for t in ("2024-01-10 05:00:00", "2024-01-12 20:00:00"))
    log = read_log(spark, path, layout=True).filter(F.col("tenant_id") == TENANT)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        rows = cut_lineage(q._prune_days(log, low, high).filter(q.in_window(low, high)).select("id", "version"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return rows


_DOCS = fx.CANONICAL + """,
docs AS (SELECT * REPLACE (CAST(CASE WHEN event_id % 20 = 0 THEN 2 ELSE 1 END AS INTEGER) AS event_version) FROM canonical)"""


def _stored_model(spark, sf_dir) -> str:
    """A stored read model: three batches and their redeliveries, a base after the second,
    and the first batch delivered again by a restarted job."""
    path = f"{run_dir(spark, 'model')}/index"
    sent = cut_lineage(fx.deliveries(spark, sf_dir).select(*COLS, "user_id", "offset")).withColumns(
        {"topic": F.lit(fx.FALLBACK), "partition": (F.col("user_id") % 6).cast("int")}
    )
    late = F.col("offset") >= 10**9
    parts = [sent.filter(~late & (F.col("offset") % 2 == 0)), sent.filter(~late & (F.col("offset") % 2 == 1)), sent.filter(late)]
    for number, part in enumerate(parts):
        upsert_projection(part, path, number, writer="bus")
        if number == 1:
            merge_projection(spark, path)
    upsert_projection(parts[0], path, 0, writer="bus")
    return path


def _document(df: DataFrame) -> DataFrame:
    return df.select(*ROW, "event_version", F.col("metadata")["region"].alias("region"))


def _doc_page_sql(where: str, order: str, limit: int, offset: int) -> str:
    return (
        f"SELECT {ROW_SQL}, event_version, region FROM docs WHERE {where} "
        f"ORDER BY {order} LIMIT {limit} OFFSET {offset}"
    )


@case(f"SELECT {ROW_SQL}, event_version, region FROM docs", _DOCS)
def stored_model_scan(spark, sf_dir):
    """Every document of the stored read model, the last delivery of each."""
    return _document(read_projection(spark, _stored_model(spark, sf_dir)))


@case(_doc_page_sql(f"tenant_id = '{TENANT}' AND stream_id = 'view:7'", "version, id", 5, 2), _DOCS)
def stored_stream_page(spark, sf_dir):
    """Q3 over S7: tenant and stream reach the scans of the base and of what came since."""
    model = read_projection(spark, _stored_model(spark, sf_dir), TENANT, "view:7")
    return _document(q.stream_page(model, TENANT, "view:7", 5, 2)[0])


@case(_doc_page_sql(f"tenant_id = '{TENANT}'", _NEWEST, 20, 40), _DOCS)
def stored_feed_page(spark, sf_dir):
    """Q4 over S7."""
    model = read_projection(spark, _stored_model(spark, sf_dir), TENANT)
    return _document(q.feed_page(model, TENANT, 20, 40)[0])


@case(f"""
SELECT count(*) AS total, 20 AS "limit", 0 AS "offset", 'elasticsearch' AS read_model, 'eventual' AS consistency
FROM docs WHERE tenant_id = '{TENANT}'""", _DOCS)
def stored_list_summary(spark, sf_dir):
    """Q10 over S7: a list without correlation is answered by the stored read model."""
    model = read_projection(spark, _stored_model(spark, sf_dir), TENANT)
    return q.list_events(fx.canonical(spark, sf_dir), model, TENANT)[1]


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A log stored in two batches, the causes of many events in the later one, and its
    labels, brought up to date after each."""
    home = run_dir(spark, "labels")
    events = fx.unversioned(spark, sf_dir)
    for number, part in enumerate(("event_id % 5 > 1", "event_id % 5 <= 1")):
        append_batch(events.filter(part).select(*COLS), f"{home}/log", number, writer="loader")
        update_labels(spark, f"{home}/log", f"{home}/labels")
    return read_log(spark, f"{home}/log"), read_labels(spark, f"{home}/labels")


@case("SELECT * FROM tree WHERE root_id IN (SELECT id FROM base WHERE causation_id = '')", _TREE)
def stored_causation_tree(spark, sf_dir):
    """A1 by stored labels: everything caused by each purchase that nothing caused."""
    log, labels = _labelled(spark, sf_dir)
    return causation.labelled_tree(labels, log.filter("type = 'user.purchase'").select("tenant_id", "id"))


@case(_INCIDENT, fx.CANONICAL.replace("base AS (", "RECURSIVE base AS (", 1))
def stored_incident(spark, sf_dir):
    """A2 by stored labels: only trees that hold a seed are read."""
    log, labels = _labelled(spark, sf_dir)
    low, high = (F.lit(t).cast("timestamp") for t in (_FROM, _TO))
    rows = causation.incident(log, TENANT, "corr-1", low, high, labels=labels)
    return rows.select("id", "stream_id", "occurred_at", "via")


@case("SELECT id, stream_id, version, lag(version) OVER (PARTITION BY stream_id ORDER BY version) AS sent_before FROM canonical")
def bus_parts(spark, sf_dir):
    """Each message with the one its stream sent before, in the order of the writes;
    the stored log is published in parts of five versions per task."""
    home = run_dir(spark, "bus")
    events = fx.unversioned(spark, sf_dir).select(*COLS)
    for number, part in enumerate((events.filter("occurred_at < '2024-01-16'"), events)):
        append_batch(part, f"{home}/log", number, writer="loader")
        drain(run_publish(spark, f"{home}/log", f"{home}/bus", f"{home}/checkpoint", fx.ROUTES, fx.FALLBACK, limit=5))
    sent = spark.read.parquet(f"{home}/bus").select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    event = from_envelope_json(sent).select("event.id", "event.stream_id", "event.version", "batch_id", "part", "file", "row")
    written = Window.partitionBy("stream_id").orderBy("batch_id", "part", "file", "row")
    return event.select("id", "stream_id", "version", F.lag("version").over(written).alias("sent_before"))


@case("""
, live AS (
  SELECT id AS source_id, stream_id, false AS is_replay, occurred_at, 0 AS phase FROM base
  UNION ALL
  SELECT id, stream_id, true, occurred_at, 1 FROM base WHERE event_id % 31 = 0 AND event_id % 41 <> 0 AND tenant_id = 'tenant-1'
)
SELECT source_id, stream_id, is_replay, row_number() OVER (PARTITION BY stream_id ORDER BY phase, occurred_at, source_id) AS version
FROM live""")
def dlq_replay(spark, sf_dir):
    """A tenant's dead-lettered events replayed into the stored log, the recovery run twice."""
    path = run_dir(spark, "recovery")
    append_batch(fx.unversioned(spark, sf_dir).select(*COLS), path, 0, writer="loader")
    refused = decode_messages(fx.bus_messages(spark, sf_dir))[0].filter(index_error().isNotNull())
    dlq = cut_lineage(to_dlq(refused, index_error(), F.lit(fx.REPLAY_TIME).cast("timestamp")))
    for batch_id in (1, 2):
        jobs.recover_dead_letters(
            spark, path, dlq, TENANT, fx.REPLAY_REASON, batch_id, fx.REPLAY_ID, safety_limit=10**9
        )
    return _sources(read_log(spark, path))


@case(f"""
SELECT id AS key, '{{"event":' || {_ENVELOPE} || ',"reason":"payload is not an object","failed_at":"2024-03-01T00:00:00Z","correlation_id":"'
  || correlation_id || '"}}' AS value, CAST('2024-03-01 00:00:00' AS TIMESTAMP) AS sent_at
FROM (SELECT * REPLACE (body AS payload, sent_version AS event_version) FROM sent WHERE NOT broken AND scalar)""", fx.SENT)
def dlq_keyed(spark, sf_dir):
    """Dead letters as bus messages, keyed by event id."""
    refused = decode_messages(fx.bus_messages(spark, sf_dir))[0].filter(index_error().isNotNull())
    dlq = to_dlq(
        refused, index_error(), F.lit(fx.REPLAY_TIME).cast("timestamp"), F.col("context.correlation_id")
    )
    rows = dlq_messages(dlq)
    return rows.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("sent_at")
    )


@case("""
SELECT event_id, b_stream AS stream_id, row_number() OVER (PARTITION BY b_stream ORDER BY event_id) AS version
FROM bodies WHERE NOT (cut OR long OR mistyped) AND b_stream <> '' AND b_type <> ''""", fx.BODIES)
def import_order(spark, sf_dir):
    """Files of request bodies imported; versions follow the lines, files in path order."""
    home = run_dir(spark, "lines")
    numbered = F.concat(F.lit('"n": '), F.col("event_id").cast("string"))
    bodies = fx.request_bodies(spark, sf_dir).withColumn("value", F.replace("value", F.lit('"n": 1.10'), numbered))
    ordered = bodies.repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    ordered.select("value").write.text(f"{home}/in")
    jobs.import_requests(spark, f"{home}/in", f"{home}/log", f"{home}/rejected", TENANT, 0, writer="import")
    number = F.get_json_object("payload", "$.n").cast("bigint")
    return read_log(spark, f"{home}/log").select(number.alias("event_id"), "stream_id", "version")
