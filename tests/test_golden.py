"""Segments of a real track and the documents that were made of them: copied as rows, compared with ours."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wakeline.operators import tracks
from wakeline.sources import geojson
from wakeline.sources.tracks import read_numbered

PAIRS = Path(__file__).parent / "data"
FIRST = {"4_0": 33200, "6_1": 18531, "6_2": 33703, "6_3": 33519, "6_4": 33790}


def rows_of(spark, name):
    rows = read_numbered(spark, str(PAIRS / f"track_{name}.csv"))
    return rows.withColumn("row_id", F.col("row_id") + FIRST[name])


def features(name):
    return json.loads((PAIRS / f"track_{name}.geojson").read_text())["features"]


@pytest.mark.parametrize("name", sorted(FIRST))
def test_documents_of_segments(spark, tmp_path, name):
    rows = rows_of(spark, name).withColumn("segment_no", F.lit(1))
    if name == "6_4":  # begins where the segment before it has ended, which hides its first point
        before = rows_of(spark, "6_3").withColumn("segment_no", F.lit(0))
        rows = before.unionByName(rows).withColumn("track_id", F.lit("6"))
    still = tracks.destutter_segments(rows, linked=True).where("segment_no = 1")
    made = geojson.track_features(still, ["segment_no"])
    geojson.write_documents(made, str(tmp_path / "out"), ["segment_no"], ["section", "ord"], F.lit(f"track_{name}.geojson"))
    got = json.loads((tmp_path / "out" / f"track_{name}.geojson").read_text())["features"]
    want = features(name)
    assert [f["id"] for f in got] == [f["id"] for f in want] and [f["geometry"] for f in got] == [f["geometry"] for f in want]
