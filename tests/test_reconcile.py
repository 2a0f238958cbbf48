import random

from pyspark.sql import functions as F

from annalog.operators.reconcile import differing_hours, hour_digests, merge_digests, reconcile
from conftest import at, event, uid


def spread(n, hours=50):
    return [event(i, tenant_id=f"t{i % 3}", occurred_at=at(3600 * (i % hours) + i % 3600)) for i in range(n)]


def sides(df):
    return sorted((r.side, r.tenant_id, r.id) for r in df.select("side", "tenant_id", "id").collect())


def test_planted_losses_on_both_sides_are_found(log_of):
    rows = spread(400)
    lost, extra = {7, 8, 9, 211, 399}, {0, 50, 300}
    log = log_of([r for i, r in enumerate(rows) if i not in extra])
    model = log_of([r for i, r in enumerate(rows) if i not in lost])
    want = [("missing", f"t{i % 3}", uid(i)) for i in lost] + [("extra", f"t{i % 3}", uid(i)) for i in extra]
    assert sides(reconcile(log, model)) == sorted(want)
    assert sides(reconcile(log, model, hour_digests(log), hour_digests(model))) == sorted(want)
    assert sides(reconcile(log, log_of([]))) == sorted(("missing", r["tenant_id"], r["id"]) for i, r in enumerate(rows) if i not in extra)
    assert sides(reconcile(log_of([]), log_of([]))) == []


def test_the_same_count_of_other_ids_is_a_difference(log_of):
    log, model = log_of([event(1), event(2)]), log_of([event(1), event(3, occurred_at=at(2))])
    assert sides(reconcile(log, model)) == [("extra", "tenant-a", uid(3)), ("missing", "tenant-a", uid(2))]


def test_digests_do_not_depend_on_order_and_add_up(log_of):
    rows = spread(300)
    shuffled = random.Random(1).sample(rows, len(rows))
    whole = hour_digests(log_of(rows))
    parts = hour_digests(log_of(shuffled[:100])).union(hour_digests(log_of(shuffled[100:])))
    assert differing_hours(whole, hour_digests(log_of(shuffled).repartition(7))).count() == 0
    assert differing_hours(whole, merge_digests(parts)).count() == 0
    assert differing_hours(whole, hour_digests(log_of(rows[1:]))).count() == 1


def test_equal_hours_are_not_read(spark, log_of, tmp_path):
    rows = spread(600, hours=24 * 10)
    for name, kept in (("log", rows), ("model", [r for i, r in enumerate(rows) if i != 30]), ("same", rows)):
        dated = log_of(kept).withColumn("occurred_date", F.to_date("occurred_at"))
        dated.write.partitionBy("occurred_date").parquet(f"{tmp_path}/{name}")
        hour_digests(log_of(kept)).write.parquet(f"{tmp_path}/{name}_digests")
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    stored = [table(f"{n}_digests") for n in ("log", "model", "same")]

    nothing = reconcile(table("log"), table("same"), stored[0], stored[2])
    plan = nothing._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/log" not in plan and f"{tmp_path}/same" not in plan
    assert nothing.count() == 0

    one = reconcile(table("log"), table("model"), stored[0], stored[1])
    assert sides(one) == [("missing", "t0", uid(30))]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(occurred_date" in plan and "2024-01-02" in plan and "2024-01-03" not in plan
    assert "GreaterThanOrEqual(occurred_at" in plan and "payload" not in plan
