"""Stored causation labels, brought up to date per batch, against the whole-log operators."""

import random

import pytest
from pyspark.sql import functions as F

from annalog.operators.causation import causation_forest, causation_roots, causation_tree, incident, labelled_forest, labelled_tree
from annalog.sources.labels import read_labels, update_labels
from annalog.sources.log import append_batch, read_log
from conftest import event, uid


def rows_of(df, *names):
    return sorted(map(str, (tuple(r) for r in df.select(*names).collect())))


def random_events(seed, n=60):
    """Trees, chains, unknown causes, cycles and self-causes; causes may come later."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        turn = rng.random()
        cause = "" if turn < 0.15 else "nobody" if turn < 0.2 else uid(rng.randrange(n)) if turn < 0.3 else uid(max(i - rng.randint(1, 3), 0))
        rows.append(event(i, causation_id=cause, tenant_id=f"tenant-{'ab'[i % 17 == 0]}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_the_whole_log(spark, log_of, tmp_path, seed):
    log_path, path = str(tmp_path / "log"), str(tmp_path / "labels")
    rows = random_events(seed)
    for number, low in enumerate(range(0, 60, 20)):
        append_batch(log_of(rows[low : low + 20]), log_path, number, writer="loader")
        if number != 1:  # the second and third batch make one update
            assert update_labels(spark, log_path, path) == number
    assert update_labels(spark, log_path, path) is None
    log, labels = read_log(spark, log_path), read_labels(spark, path, limit=5)
    names = ["tenant_id", "id", "root_id", "depth"]
    assert rows_of(labels, *names) == rows_of(causation_roots(log), *names)
    seeds = log.filter(F.col("id").isin([uid(n) for n in (3, 4, 20, 31, 45)])).select("tenant_id", "id")
    for depth in (None, 2):
        mine = labelled_forest(labels, seeds, depth, limit=5)
        assert rows_of(mine, "tenant_id", "id", "depth") == rows_of(causation_forest(log, seeds, depth), "tenant_id", "id", "depth")
    roots = labels.filter("depth = 0").select("tenant_id", "id")
    names = ["tenant_id", "root_id", "id", "depth"]
    assert rows_of(labelled_tree(labels, roots), *names) == rows_of(causation_tree(log, roots), *names)
    one = incident(log, "tenant-a", correlation_id="corr-20")
    two = incident(log, "tenant-a", correlation_id="corr-20", labels=labels)
    assert rows_of(two, "id", "via") == rows_of(one, "id", "via")


def test_late_causes_link_trees_and_close_cycles(spark, log_of, tmp_path):
    log_path, path = str(tmp_path / "log"), str(tmp_path / "labels")
    assert update_labels(spark, log_path, path) is None
    assert read_labels(spark, path).count() == 0

    def add(number, *rows):
        append_batch(log_of([event(i, causation_id=uid(c) if c else "") for i, c in rows]), log_path, number, writer="loader")
        update_labels(spark, log_path, path)
        return {r.id: (r.root_id, r.depth) for r in read_labels(spark, path).collect()}

    found = add(0, (1, 2), (10, 1))
    assert found == {uid(1): (uid(1), 0), uid(10): (uid(1), 1)}
    found = add(1, (2, 3))  # 1's cause, itself waiting for 3
    assert found[uid(10)] == (uid(2), 2)
    found = add(2, (3, 0), (11, 10))
    assert found[uid(11)] == (uid(3), 4) and found[uid(1)] == (uid(3), 2)
    found = add(3, (20, 21))
    found = add(4, (21, 20), (22, 21))  # closes a cycle
    assert {found[uid(n)] for n in (20, 21, 22)} == {(None, None)}
    found = add(5, (23, 22))
    assert found[uid(23)] == (None, None) and found[uid(3)] == (uid(3), 0)
