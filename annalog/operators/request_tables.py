"""Many timeline or replay requests at once, as a table joined to the log.

A range join of requests with events would pair every wide request with a large
part of the log. Instead events are counted per key (tenant and whatever else a
request fixes) and hour, and the counts summed up over the hours. Only the hours that
hold a bound are numbered event by event, together with their bounds; so a bound says
how many events lie before it, and a total is the difference of two numbers. Positions
a request really returns (a page, or at most its safety limit) are joined back by
equality, with the events of the hours they lie in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalog.functions.envelope import parse_rfc3339
from annalog.functions.trace import blank_to_null
from annalog.operators.numbering import (
    hour_digit,
    instant_digit,
    running_total,
    text_digit,
)
from annalog.operators.skew import MAX_ROWS_PER_TASK, small_side
from annalog.schema import (
    FROM_TIME_BAD,
    LIMIT_EXCEEDED,
    PAGE_LIMIT_DEFAULT,
    PAGE_LIMIT_MAX,
    REASON_MISSING,
    REPLAY_LIMIT_DEFAULT,
    SCOPE_MISSING,
    TENANT_MISMATCH,
    TENANT_MISSING,
    TO_TIME_BAD,
)
from annalog.session import cut_lineage

MAX_TENANT_FILTER = 100  # asked tenants that are pushed to the scan as values
BLOCK = 256  # positions at which returned ranges and hours meet

OPTIONAL_FIELDS = ("stream_id", "correlation_id", "event_type", "actor_id")


def parse_bounds(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with from_at, to_at, rejected requests). Empty text means no bound."""

    def bound(name: str) -> Column:
        return parse_rfc3339(blank_to_null(F.col(name)))

    def bad(name: str) -> Column:
        return blank_to_null(F.col(name)).isNotNull() & F.col(f"{name[:-5]}_at").isNull()

    judged = requests.withColumns({"from_at": bound("from_time"), "to_at": bound("to_time")}).withColumn(
        "reject_reason",
        F.when(bad("from_time"), F.lit(FROM_TIME_BAD)).when(bad("to_time"), F.lit(TO_TIME_BAD)),
    )
    return (
        judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.filter(F.col("reject_reason").isNotNull()).drop("from_at", "to_at"),
    )


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay request rules: (accepted with defaults applied, rejected with reason)."""
    parsed, bad_bounds = parse_bounds(requests)
    has_ids = F.coalesce(F.size("event_ids"), F.lit(0)) > 0

    def empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    reason = (
        F.when(empty("caller_tenant"), F.lit(TENANT_MISSING))
        .when(
            ~F.coalesce("dry_run", F.lit(False)) & empty("replay_reason"),
            F.lit(REASON_MISSING),
        )
        .when(empty("tenant_id") & ~has_ids, F.lit(SCOPE_MISSING))
        .when(
            ~empty("tenant_id") & (F.col("tenant_id") != F.col("caller_tenant")),
            F.lit(TENANT_MISMATCH),
        )
    )
    judged = parsed.withColumn("reject_reason", reason)
    accepted = (
        judged.filter(F.col("reject_reason").isNull())
        .drop("reject_reason")
        .withColumns(
            {
                "tenant_id": F.coalesce(blank_to_null(F.col("tenant_id")), F.col("caller_tenant")),
                "safety_limit": F.when(F.col("safety_limit") > 0, F.col("safety_limit")).otherwise(
                    F.lit(REPLAY_LIMIT_DEFAULT)
                ),
            }
        )
    )
    rejected = judged.filter(F.col("reject_reason").isNotNull()).drop("from_at", "to_at")
    return accepted, rejected.unionByName(bad_bounds)


def _clip(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events no request can match are left out at the scan: other tenants', and those
    outside all bounds where every request has one. Few tenants are a filter that the
    scan takes; more than `MAX_TENANT_FILTER` are a semi-join. Totals stay the same:
    bounds count within what is kept."""
    per_tenant = requests.groupBy("tenant_id").agg(
        F.min(F.unix_micros("from_at")).alias("low"),
        F.max(F.unix_micros("to_at")).alias("high"),
        F.count_if(F.col("from_at").isNull()).alias("no_low"),
        F.count_if(F.col("to_at").isNull()).alias("no_high"),
    )
    named = per_tenant.limit(MAX_TENANT_FILTER + 1).collect()
    if len(named) <= MAX_TENANT_FILTER:
        events = events.filter(F.col("tenant_id").isin([r.tenant_id for r in named]))
    else:
        events = events.join(small_side(per_tenant.select("tenant_id")), "tenant_id", "left_semi")
        named = per_tenant.agg(
            *[F.min("low").alias("low"), F.max("high").alias("high")],
            *[F.sum(c).alias(c) for c in ("no_low", "no_high")],
        ).collect()
    kept = F.lit(True)
    # As numbers: a collected timestamp would go through the driver's zone.
    if named and not any(r.no_low for r in named):
        kept = kept & (F.col("occurred_at") >= F.timestamp_micros(F.lit(min(r.low for r in named))))
    if named and not any(r.no_high for r in named):
        kept = kept & (F.col("occurred_at") <= F.timestamp_micros(F.lit(max(r.high for r in named))))
    return events.filter(kept)


def _hours(points: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """Per key and hour that has events or a bound: `_n` events, `_before` in earlier hours.

    Counts combine map-side; the window sees one row per hour of a key."""
    counts = points.groupBy(*key, hour_digit(F.col("occurred_at")).alias("_hour")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    marks = [
        requests.filter(F.col(c).isNotNull()).select(
            *key, hour_digit(F.col(c)).alias("_hour"), F.lit(0).cast("bigint").alias("_n")
        )
        for c in ("from_at", "to_at")
    ]
    cells = counts.unionByName(marks[0]).unionByName(marks[1]).groupBy(*key, "_hour").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint"))))


def _spans(
    points: DataFrame, requests: DataFrame, hours: DataFrame, key: list[str], limit: int
) -> DataFrame:
    """`requests` with `lo`, `hi`, `total`: the matches are the positions lo + 1 … hi of the key.

    A bound is its hour's start plus the events of that one hour before it: only hours
    that hold a bound are numbered, events and bounds together."""
    cell = [*key, "_hour"]

    def bounds(column: str, side: int) -> DataFrame:
        return requests.filter(F.col(column).isNotNull()).select(
            *key,
            hour_digit(F.col(column)).alias("_hour"),
            F.col(column).alias("_t"),
            F.lit(side).alias("_side"),
            F.col("request_id").alias("_who"),
        )

    # side: 0 = lower bound, sorts before events of its instant; 2 = upper bound.
    edges = bounds("from_at", 0).unionByName(bounds("to_at", 2))
    near = points.select(
        *key,
        hour_digit(F.col("occurred_at")).alias("_hour"),
        F.col("occurred_at").alias("_t"),
        F.lit(1).alias("_side"),
        F.col("id").alias("_who"),
    ).join(small_side(edges.select(*cell).distinct()), cell, "left_semi")
    ranked = running_total(
        near.unionByName(edges),
        cell,
        order=[F.col("_t"), F.col("_side"), F.col("_who")],
        digits=[
            instant_digit(F.col("_t")),
            F.col("_side").cast("bigint") * (1 << 42) + text_digit(F.col("_who"), 2),
        ],
        weight=(F.col("_side") == 1).cast("bigint"),
        name="_inside",
        limit=limit,
    ).filter("_side <> 1")
    found = (
        ranked.join(small_side(hours), cell)
        .groupBy(F.col("_who").alias("request_id"))
        .agg(
            F.max(F.when(F.col("_side") == 0, F.col("_before") + F.col("_inside"))).alias("_lo"),
            F.max(F.when(F.col("_side") == 2, F.col("_before") + F.col("_inside"))).alias("_hi"),
        )
    )
    sizes = hours.groupBy(*key).agg(F.sum("_n").alias("_size"))
    return (
        requests.join(found, "request_id", "left")
        .join(small_side(sizes), key, "left")
        .withColumns(
            {
                "lo": F.coalesce("_lo", F.lit(0).cast("bigint")),
                "hi": F.coalesce("_hi", "_size", F.lit(0).cast("bigint")),
            }
        )
        .withColumn("total", F.greatest(F.col("hi") - F.col("lo"), F.lit(0).cast("bigint")))
        .drop("_lo", "_hi", "_size")
    )


def _at_positions(
    points: DataFrame, hours: DataFrame, wanted: DataFrame, key: list[str], limit: int
) -> DataFrame:
    """`wanted` (the key, first, last, others) once per position in first … last, with the
    `id` there.

    Ranges and hours meet by blocks of positions, by equality; events are read and
    numbered only in the hours that some range touches."""
    cell = [*key, "_hour"]

    def blocks(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))

    pieces = wanted.withColumn("_block", blocks(F.col("first"), F.col("last")))
    touched = (
        hours.filter("_n > 0")
        .withColumn("_block", blocks(F.col("_before") + 1, F.col("_before") + F.col("_n")))
        .join(small_side(pieces.select(*key, "_block").distinct()), [*key, "_block"], "left_semi")
        .select(*cell, "_before")
        .distinct()
    )
    near = points.select(
        *key, "occurred_at", "id", hour_digit(F.col("occurred_at")).alias("_hour")
    ).join(small_side(touched), cell)
    placed = running_total(
        near,
        cell,
        order=[F.col("occurred_at"), F.col("id")],
        digits=[instant_digit(F.col("occurred_at")), text_digit(F.col("id"))],
        name="_inside",
        limit=limit,
    ).select(*key, "id", (F.col("_before") + F.col("_inside")).alias("position"))
    exact = pieces.withColumn(
        "position",
        F.explode(
            F.sequence(
                F.greatest(F.col("first"), F.col("_block") * BLOCK),
                F.least(F.col("last"), (F.col("_block") + 1) * BLOCK - 1),
            )
        ),
    ).drop("_block")
    return placed.join(exact, [*key, "position"])


def timeline_totals(
    events: DataFrame, requests: DataFrame, limit: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Number of events each accepted timeline request matches."""
    key = ["tenant_id"]
    requests = cut_lineage(requests)
    events = _clip(events, requests)
    spans = _spans(events, requests, _hours(events, requests, key), key, limit)
    return spans.select("request_id", "tenant_id", "total")


def timeline_pages(
    events: DataFrame, requests: DataFrame, limit: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """The newest-first page of every request: request_id, place (1 …), id, total.

    `requests`: request_id, tenant_id, from_at, to_at, limit, offset.
    """
    key = ["tenant_id"]
    requests = cut_lineage(requests)
    events = _clip(events, requests)
    hours = _hours(events, requests, key)
    size = F.when(F.coalesce("limit", F.lit(0)) <= 0, F.lit(PAGE_LIMIT_DEFAULT)).otherwise(
        F.least(F.col("limit"), F.lit(PAGE_LIMIT_MAX))
    )
    skip = F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("bigint")
    wanted = (
        _spans(events, requests, hours, key, limit)
        .withColumn("last", F.col("hi") - skip)
        .withColumn("first", F.greatest(F.col("last") - size + 1, F.col("lo") + 1))
        .filter("last >= first")
        .select("request_id", "tenant_id", "total", "first", "last")
    )
    found = _at_positions(events, hours, cut_lineage(wanted), key, limit)
    place = F.col("last") - F.col("position") + 1
    return found.select("request_id", "tenant_id", place.alias("place"), "id", "total")


def _by_ids(events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = requests.select(
        "request_id", "tenant_id", "safety_limit", F.explode(F.array_distinct("event_ids")).alias("id")
    )
    hits = asked.join(events.select("tenant_id", "id"), ["tenant_id", "id"])
    counted = (
        requests.select("request_id", "tenant_id", "safety_limit")
        .join(hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("total")), "request_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
    )
    fit = counted.filter(F.col("total") <= F.col("safety_limit")).select("request_id")
    return counted, hits.select("request_id", "tenant_id", "id").join(fit, "request_id", "left_semi")


def match_requests(
    events: DataFrame, requests: DataFrame, limit: int = MAX_ROWS_PER_TASK
) -> tuple[DataFrame, DataFrame]:
    """Replay matching for a table of accepted requests (`validate_requests`).

    Returns (request_id, tenant_id, matched_count, status) with status 'ok' or
    'limit_exceeded', and (request_id, tenant_id, id) for the requests that are ok.

    Requests with ids join by id. Every other request gets a scope: which optional
    fields it gives (16 combinations at most) and their values. Events are taken
    into the asked scopes only, and counted there by hour.
    """
    requests = cut_lineage(requests)
    with_ids = F.coalesce(F.size("event_ids"), F.lit(0)) > 0
    by_id = requests.filter(with_ids)
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in OPTIONAL_FIELDS]
    shape = F.concat(*[F.when(g, F.lit("1")).otherwise(F.lit("0")) for g in given])
    scoped = requests.filter(~with_ids).withColumn("_shape", shape).withColumn(
        "scope",
        _scope(F.col("_shape"), [F.when(g, F.col(c)) for g, c in zip(given, OPTIONAL_FIELDS)]),
    )
    shapes = [r[0] for r in scoped.select("_shape").distinct().collect()]  # 16 at most
    counted, hits = _by_ids(events, by_id)
    if shapes:
        fields = [F.col("type" if c == "event_type" else c) for c in OPTIONAL_FIELDS]
        options = F.array(
            *[
                _scope(F.lit(s), [f for f, bit in zip(fields, s) if bit == "1"])
                for s in sorted(shapes)
            ]
        )
        key = ["scope"]
        points = (
            _clip(events, scoped)
            .select("occurred_at", "id", F.explode(options).alias("scope"))
            .join(small_side(scoped.select("scope").distinct()), "scope", "left_semi")
        )
        hours = _hours(points, scoped, key)
        spans = cut_lineage(
            _spans(points, scoped, hours, key, limit).select(
                "request_id", "tenant_id", "scope", "safety_limit", "lo", "hi", "total"
            )
        )
        counted = counted.unionByName(
            spans.select("request_id", "tenant_id", "safety_limit", "total")
        )
        wanted = spans.filter((F.col("total") > 0) & (F.col("total") <= F.col("safety_limit"))).select(
            "request_id", "tenant_id", "scope", (F.col("lo") + 1).alias("first"), F.col("hi").alias("last")
        )
        hits = hits.unionByName(
            _at_positions(points, hours, wanted, key, limit).select("request_id", "tenant_id", "id")
        )
    summary = counted.select(
        "request_id",
        "tenant_id",
        F.col("total").alias("matched_count"),
        F.when(F.col("total") > F.col("safety_limit"), F.lit(LIMIT_EXCEEDED))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )
    return summary, hits


def _scope(shape: Column, values: Sequence[Column]) -> Column:
    """Which fields are given, the tenant, and their values, each after its length, as one
    text key: no value can look like another request's."""
    sized = [F.concat(F.char_length(v).cast("string"), F.lit(":"), v) for v in (F.col("tenant_id"), *values)]
    return F.concat_ws("\u001f", shape, *sized)
