import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from annalog.schema import EVENT_SCHEMA  # noqa: E402
from annalog.session import apply_conf  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("annalog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = apply_conf(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def uid(n: int) -> str:
    return f"{n:08x}-0000-4000-8000-{n:012x}"


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def event(n: int, **given):
    row = {
        "id": uid(n),
        "tenant_id": "tenant-a",
        "stream_id": "parcel:1",
        "type": "parcel.scanned",
        "source": "depot-app",
        "version": 0,
        "event_version": 1,
        "occurred_at": at(n),
        "payload": '{"n": 1}',
        "metadata": {},
        "correlation_id": f"corr-{n}",
        "causation_id": "",
        "actor_id": "",
        "trace_id": "",
        "source_version": "",
        "is_replay": False,
        "replay_id": "",
        "replayed_at": None,
        "replay_reason": "",
        "replay_source_event_id": "",
    }
    row.update(given)
    return row


@pytest.fixture
def log_of(spark):
    def make(rows):
        return spark.createDataFrame([tuple(r[c] for c in EVENT_SCHEMA.fieldNames()) for r in rows], EVENT_SCHEMA)

    return make
