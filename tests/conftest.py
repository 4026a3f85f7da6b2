from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wayside.schemas import CAMERA, PASSAGE, TAXI_AREA  # noqa: E402
from wayside.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "wayside-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.wayside.localZone": "Europe/Brussels",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


PASSAGE_DEFAULTS = {
    "passage_id": "00000000-0000-0000-0000-000000000001",
    "passage_at": datetime(2024, 3, 12, 10, 15, 30),
    "created_at": datetime(2024, 3, 12, 10, 16),
    "volgnummer": 1,
    "version": "passage-v1",
    "camera_id": "cam-1",
    "camera_naam": "ANPR-01001-A - Rijstrook 1",
    "camera_kijkrichting": 90.0,
    "rijrichting": 1,
    "kenteken_land": "NL",
    "kenteken_hash": "h1",
    "voertuig_soort": "Bedrijfsauto",
    "toegestane_maximum_massa_voertuig": 9000,
}

CAMERA_DEFAULTS = {
    "camera_id": "cam-1",
    "camera_naam": "ANPR-01001-A - Rijstrook 1",
    "camera_kijkrichting": 90.0,
    "rijrichting": 1,
    "rijrichting_correct": True,
    "order_kaart": 3,
    "order_naam": "Punt",
    "cordon": "S100",
    "richting": "in",
    "location": (52.3, 4.8),
}


def _frame(spark, schema, defaults, rows):
    full = [{**defaults, **row} for row in rows]
    return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in full], schema)


@pytest.fixture
def make_passages(spark):
    """Passages from keyword rows; ids are numbered unless given."""

    def make(*rows):
        numbered = [
            {"passage_id": f"00000000-0000-0000-0000-{n:012d}", **row} for n, row in enumerate(rows)
        ]
        return _frame(spark, PASSAGE, PASSAGE_DEFAULTS, numbered)

    return make


@pytest.fixture
def make_cameras(spark):
    return lambda *rows: _frame(spark, CAMERA, CAMERA_DEFAULTS, rows)


@pytest.fixture
def make_areas(spark):
    return lambda *rows: spark.createDataFrame(list(rows), TAXI_AREA)
