"""Causation trees over the whole log. `causation_id` is free text, so cycles and
unknown causes occur; an event whose cause is unknown in its tenant is a root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.operators.audit_queries import in_window
from annalog.operators.lookup import lookup
from annalog.operators.skew import MAX_ROWS_PER_TASK, small_side
from annalog.session import cut_lineage

# Doubling reaches depth 2^rounds; no chain of rows is longer than that.
MAX_ROUNDS = 62


def climb(state: DataFrame, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Pointer doubling on (tenant_id, id, up, depth, done): `up` is an ancestor `depth`
    steps above, `done` says that it is an end. Each round an open row adopts its
    ancestor's ancestor, so d steps take log2(d) rounds, each stored in the shared
    folder. Rows that lead into a cycle stay open. An open row's `up` is a row's `id`.
    """
    state = cut_lineage(state)
    open_before = state.filter(~F.col("done")).count()
    for _ in range(MAX_ROUNDS):
        if open_before == 0:
            break
        ancestors = state.select(
            "tenant_id",
            F.col("id").alias("up"),
            F.col("up").alias("above"),
            F.col("depth").alias("more"),
            F.col("done").alias("above_done"),
        )
        moved = lookup(
            state.filter(~F.col("done")), ancestors, ["tenant_id", "up"], "_a", limit=limit
        ).select(
            "tenant_id",
            "id",
            F.col("_a.above").alias("up"),
            (F.col("depth") + F.col("_a.more")).alias("depth"),
            F.col("_a.above_done").alias("done"),
        )
        state = cut_lineage(state.filter("done").unionByName(moved))
        open_now = state.filter(~F.col("done")).count()
        # While a finite chain is open, each round finishes some of its events.
        if open_now == open_before:
            break
        open_before = open_now
    return state


def causation_roots(df: DataFrame, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """For every event: root_id and depth (0 for a root); both NULL for events that
    are in, or caused by, a cycle.

    Pointer doubling (`climb`): a chain of depth d takes log2(d) rounds, each a join of
    unfinished events with the table itself.
    """
    events = df.select("tenant_id", "id", F.nullif("causation_id", F.lit("")).alias("up"))
    known = events.select("tenant_id", F.col("id").alias("up"))
    caused = lookup(
        events.filter(F.col("up").isNotNull()), known, ["tenant_id", "up"], "_cause", limit=limit
    ).select("tenant_id", "id", F.when(F.col("_cause").isNotNull(), F.col("up")).alias("up"))
    state = events.filter(F.col("up").isNull()).unionByName(caused).select(
        "tenant_id",
        "id",
        F.coalesce("up", "id").alias("up"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.col("up").isNull().alias("done"),
    )
    state = climb(state, limit)
    return state.select(
        "tenant_id",
        "id",
        F.when(F.col("done"), F.col("up")).alias("root_id"),
        F.when(F.col("done"), F.col("depth")).alias("depth"),
    )


def causation_tree(
    df: DataFrame,
    roots: DataFrame,
    max_depth: int | None = None,
    limit: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """All events below each of `roots` (tenant_id, id): root_id, id, causation_id, depth.

    One round per level: the effects of the last level that this root has not
    visited yet, so cycles end. An effect has one cause; the join is many-to-one
    from the log's edges to the current level when the roots do not overlap.
    """
    edges = df.filter(F.col("causation_id") != "").select("tenant_id", "id", "causation_id")
    level = cut_lineage(
        roots.select("tenant_id", "id").distinct().join(
            df.select("tenant_id", "id", "causation_id"), ["tenant_id", "id"]
        ).select(
            "tenant_id", F.col("id").alias("root_id"), "id", "causation_id", F.lit(0).alias("depth")
        )
    )
    visited = level
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        causes = level.select("tenant_id", "root_id", F.col("id").alias("causation_id"))
        # Edges on the left: AQE can split a cause with very many effects.
        reached = edges.join(causes, ["tenant_id", "causation_id"]).select(
            "tenant_id", "root_id", "id", "causation_id", F.lit(depth).alias("depth")
        )
        level = cut_lineage(
            reached.join(visited.select("tenant_id", "root_id", "id"), ["tenant_id", "root_id", "id"], "left_anti")
        )
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def incident(
    df: DataFrame,
    tenant: str,
    correlation_id: str = "",
    from_time=None,
    to_time=None,
    max_depth: int | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Everything that belongs to an incident, each event once, with why it is in.

    The correlation set and the time window (where given), and everything those
    events caused. `via` is the first reason of correlation, window, causation.
    With `labels` of the same events (`sources/labels.py`) only trees that hold a seed are
    read; without, every level reads the tenant's events.
    """
    mine = df.filter(F.col("tenant_id") == tenant)
    seeds = mine.limit(0).withColumn("why", F.lit(0))
    if correlation_id:
        chosen = mine.filter(F.col("correlation_id") == correlation_id)
        seeds = seeds.unionByName(chosen.withColumn("why", F.lit(1)))
    if from_time is not None or to_time is not None:
        seeds = seeds.unionByName(
            mine.filter(in_window(from_time, to_time)).withColumn("why", F.lit(2))
        )
    if labels is None:
        tree = causation_forest(mine, seeds.select("tenant_id", "id"), max_depth)
    else:
        own = labels.filter(F.col("tenant_id") == tenant)
        tree = labelled_forest(own, seeds.select("tenant_id", "id"), max_depth)
    found = seeds.select("id", "why").unionByName(tree.select("id", F.lit(3).alias("why")))
    reason = found.groupBy("id").agg(F.min("why").alias("why"))
    names = F.when(F.col("why") == 1, "correlation").when(F.col("why") == 2, "window")
    return mine.join(reason, "id").withColumn("via", names.otherwise("causation")).drop("why")


def causation_forest(df: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every event reachable from any seed, once: (tenant_id, id, depth).

    Unlike `causation_tree` it does not keep which seed reached an event, so
    overlapping seeds do not multiply rows.
    """
    edges = df.filter(F.col("causation_id") != "").select("tenant_id", "id", "causation_id")
    level = cut_lineage(seeds.select("tenant_id", "id").distinct().withColumn("depth", F.lit(0)))
    visited = level
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        causes = level.select("tenant_id", F.col("id").alias("causation_id"))
        reached = edges.join(causes, ["tenant_id", "causation_id"], "left_semi").select(
            "tenant_id", "id", F.lit(depth).alias("depth")
        )
        level = cut_lineage(
            reached.join(visited.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti")
        )
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def labelled_tree(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything below `roots` (tenant_id, id), which are roots of their trees: one lookup
    of their label. Same columns as `causation_tree`; other events give no row."""
    wanted = roots.select("tenant_id", F.col("id").alias("root_id")).distinct()
    return labels.join(small_side(wanted), ["tenant_id", "root_id"], "left_semi").select(
        "tenant_id", "root_id", "id", F.coalesce("causation_id", F.lit("")).alias("causation_id"), F.col("depth").cast("int").alias("depth")
    )


def labelled_forest(
    labels: DataFrame, seeds: DataFrame, max_depth: int | None = None, limit: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """`causation_forest` by labels (tenant_id, id, causation_id, root_id, depth).

    Events of the seeds' trees are kept by their root and stored once; among these each
    event climbs to the next seed or root above it, log2(depth) rounds. An event in a
    cycle, or caused by one, has no root; all such events are kept if a seed is one.
    """
    seeds = cut_lineage(seeds.select("tenant_id", "id").distinct())
    root = F.coalesce("root_id", F.lit(""))
    rows = labels.withColumn("_root", root)
    trees = cut_lineage(rows.join(small_side(seeds), ["tenant_id", "id"], "left_semi").select("tenant_id", "_root").distinct())
    marked = seeds.withColumn("_seed", F.lit(True))
    kept = rows.join(small_side(trees), ["tenant_id", "_root"], "left_semi").join(
        small_side(marked), ["tenant_id", "id"], "left"
    )
    end = F.col("_seed").isNotNull() | (F.col("id") == F.col("_root"))
    state = kept.select(
        "tenant_id",
        "id",
        F.when(end, F.col("id")).otherwise(F.col("causation_id")).alias("up"),
        F.when(end, 0).otherwise(1).cast("bigint").alias("depth"),
        end.alias("done"),
    )
    found = climb(state, limit).filter("done").select("tenant_id", F.col("id").alias("_id"), F.col("up").alias("id"), "depth")
    found = lookup(found, marked, ["tenant_id", "id"], "_s", limit=limit).filter(F.col("_s").isNotNull())
    found = found.select("tenant_id", F.col("_id").alias("id"), F.col("depth").cast("int").alias("depth"))
    return found if max_depth is None else found.filter(F.col("depth") <= max_depth)
