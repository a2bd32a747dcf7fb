import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewrank.session import local_session  # noqa: E402

FLAT = (
    "event_seq BIGINT, session_id STRING, ts_ms BIGINT, channel STRING, detector STRING, detector_version STRING, event_type STRING, "
    "confidence DOUBLE, p0 DOUBLE, p1 DOUBLE, p2 DOUBLE, p3 DOUBLE, label STRING, usable BOOLEAN, frame_blur DOUBLE, frame_luma DOUBLE"
)


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SHUFFLE_PARTITIONS", "4")
    return local_session("4", "6g")


@pytest.fixture
def flat(spark):
    """Flat events from short tuples ``(session, ts, type, p0..p3, label)``."""
    from reviewrank.functions import registry as R

    def make(rows, **over):
        out = []
        for i, (sid, ts, kind, *rest) in enumerate(rows):
            p = (list(rest) + [None] * 5)[:5]
            row = {"event_seq": i, "session_id": sid, "ts_ms": ts, "channel": R.TYPES[kind]["channel"], "detector": "d", "detector_version": "1",
                   "event_type": kind, "confidence": 0.9, "p0": p[0], "p1": p[1], "p2": p[2], "p3": p[3], "label": p[4], "usable": True,
                   "frame_blur": None, "frame_luma": None}
            row.update({k: v[i] for k, v in over.items()})
            out.append(tuple(None if v is None else (float(v) if k in ("p0", "p1", "p2", "p3") else v) for k, v in row.items()))
        return spark.createDataFrame(out, FLAT)

    return make


@pytest.fixture
def tiny_tasks(spark):
    """Cut every order into several chunks, however few rows it has."""
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
