"""The read model as a base and what came since."""

import random
import re

from pyspark.sql import functions as F

from annalog.sources.batches import read_batches
from annalog.sources.projection import merge_projection, read_projection, upsert_projection
from conftest import event, uid


def deliver(log_of, rows):
    """(event, partition, offset) rows with their position."""
    df = log_of([e for e, _, _ in rows])
    place = {(e["id"], e["event_version"]): (p, o) for e, p, o in rows}
    spark = df.sparkSession
    keys = spark.createDataFrame(
        [(i, v, "t", p, o) for (i, v), (p, o) in place.items()],
        "id string, event_version int, topic string, partition int, offset long",
    )
    return df.join(keys, ["id", "event_version"])


def versions(spark, path, **scope):
    return {r.id: r.event_version for r in read_projection(spark, path, **scope).collect()}


def test_random_deliveries_against_a_dictionary(spark, log_of, tmp_path):
    path, rng, expected = str(tmp_path / "index"), random.Random(3), {}
    assert read_projection(spark, path).count() == 0
    contract = 0
    for number in range(5):
        rows, best = [], {}
        for _ in range(30):
            contract += 1
            n, place = rng.randrange(12), (rng.randrange(3), rng.randrange(10**6))
            rows.append((event(n, event_version=contract, tenant_id=f"tenant-{n % 2}", stream_id=f"s:{n % 4}"), *place))
            best[uid(n)] = max(best.get(uid(n), ((-1, -1), 0)), (place, contract))
        expected |= {i: v for i, (_, v) in best.items()}
        assert upsert_projection(deliver(log_of, rows), path, number, "bus") == number
        if number in (1, 3):
            merge_projection(spark, path)
        assert versions(spark, path) == expected
    odd = {uid(n): expected[uid(n)] for n in range(12) if n % 2 == 1 and n % 4 == 3 and uid(n) in expected}
    assert versions(spark, path, tenant="tenant-1", stream_id="s:3") == odd


def test_a_batch_that_counts_is_not_written_again(spark, log_of, tmp_path):
    path = str(tmp_path / "index")
    one, two = ([(event(n, event_version=v), 0, n) for n in range(3)] for v in (1, 2))
    upsert_projection(deliver(log_of, one), path, 0, "bus")
    files = set(spark.read.parquet(path).inputFiles())
    assert upsert_projection(deliver(log_of, two), path, 0, "bus") == 0
    assert set(spark.read.parquet(path).inputFiles()) == files
    # The same number of another job is another batch.
    assert upsert_projection(deliver(log_of, two), path, 0, "log") == 1
    assert set(versions(spark, path).values()) == {2}
    assert read_batches(spark, path).count() == 2


def test_killed_writers_are_not_seen(spark, log_of, tmp_path):
    path = str(tmp_path / "index")
    first = deliver(log_of, [(event(1), 0, 1)])
    upsert_projection(first, path, 0, "bus")
    # Written, but killed before they counted: a batch and a base.
    dead = deliver(log_of, [(event(1, event_version=9), 0, 2), (event(2), 0, 3)])
    dead.write.parquet(f"{path}/batch_id=1")
    dead.write.parquet(f"{path}_base/batch_id=0")
    assert versions(spark, path) == {uid(1): 1}
    upsert_projection(deliver(log_of, [(event(3), 0, 4)]), path, 1, "bus")
    merge_projection(spark, path)
    merge_projection(spark, path)
    assert versions(spark, path) == {uid(1): 1, uid(3): 1}


def test_copies_of_one_message_and_empty_batches(spark, log_of, tmp_path):
    path = str(tmp_path / "index")
    once = deliver(log_of, [(event(1), 0, 1)])
    upsert_projection(once.limit(0), path, 0, "bus")
    assert versions(spark, path) == {}
    upsert_projection(once.unionByName(once).unionByName(once), path, 1, "bus")
    nowhere = deliver(log_of, [(event(2), 0, 1)]).withColumns(
        {"topic": F.lit(None).cast("string"), "partition": F.lit(None).cast("int"), "offset": F.lit(None).cast("long")}
    )
    upsert_projection(nowhere, path, 2, "bus")
    rows = read_projection(spark, path).collect()
    assert sorted(r.id for r in rows) == [uid(1), uid(2)]


def test_no_whole_row_is_grouped_and_filters_reach_the_scans(spark, log_of, tmp_path):
    path = str(tmp_path / "index")
    upsert_projection(deliver(log_of, [(event(n), 0, n) for n in range(9)]), path, 0, "bus")
    merge_projection(spark, path)
    upsert_projection(deliver(log_of, [(event(2, event_version=2), 0, 20)]), path, 1, "bus")
    df = read_projection(spark, path, tenant="tenant-a", stream_id="parcel:1")
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    for block in re.split(r"\n\n+", plan):
        if "Aggregate" in block.split("\n")[0]:
            assert "payload" not in block
    scans = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert sum("EqualTo(stream_id,parcel:1)" in s and "EqualTo(tenant_id,tenant-a)" in s for s in scans) >= 2
    assert versions(spark, path) == {uid(n): 1 + (n == 2) for n in range(9)}
