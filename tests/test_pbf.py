"""Map extracts in blocks: numbers, ranges of bytes, folders, compressions, and a way there and back."""

import bz2
import lzma
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from wakeline.sources import osm, osm_pbf


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_numbers_come_back(values):
    data, size = osm_pbf.packed(np.array(values, np.uint64))
    assert osm_pbf.numbers(data).tolist() == values and size.sum() == len(data)


@given(st.lists(st.integers(-(2**62), 2**62)))
def test_signs_come_back(values):
    assert osm_pbf.signed(osm_pbf.unsigned(np.array(values, np.int64))).tolist() == values


@pytest.fixture(scope="module")
def extract(spark):
    rng = random.Random(2)
    tags = lambda: {rng.choice("abc"): rng.choice(["x", "é", ""]) for _ in range(rng.randrange(3))}
    nodes = [(i * 3 - 500, round(rng.uniform(-90, 90), 7), round(rng.uniform(-180, 180), 7), tags()) for i in range(3000)]
    ways = [(i, [rng.randrange(10**12) - 5 for _ in range(rng.randrange(6))], tags()) for i in range(400)]
    relations = [(10**15 + i, [(rng.choice(osm_pbf.MEMBER_TYPES), rng.randrange(99), rng.choice(["", "outer"])) for _ in range(rng.randrange(4))], tags()) for i in range(90)]
    return {
        "nodes": spark.createDataFrame(nodes, "id long, lat double, lon double, tags map<string,string>"),
        "ways": spark.createDataFrame(ways, "id long, refs array<long>, tags map<string,string>"),
        "relations": spark.createDataFrame(relations, "id long, members array<struct<type:string, ref:long, role:string>>, tags map<string,string>"),
    }


def rows(df):
    return sorted(str([round(x, 6) if isinstance(x, float) else sorted(x.items()) if isinstance(x, dict) else x for x in r]) for r in df.collect())


@pytest.mark.parametrize("range_bytes", [700, 1 << 20])
def test_there_and_back_by_ranges(spark, extract, tmp_path, range_bytes, monkeypatch):
    path = str(tmp_path / "out")
    assert osm_pbf.write_pbf(extract, path, block_rows=100) > 2
    for once in (False, True):
        back = osm.read_pbf(spark, path, once=once)
        for name, table in extract.items():
            assert rows(back[name]) == rows(table.select(back[name].columns))
    reader = osm_pbf._Reader(path, range_bytes)
    ids = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(ids) == len(set(ids)) == 3490
    assert len(reader.partitions()) > 50 or range_bytes > 700
    one = min((tmp_path / "out").glob("part-*.pbf"))
    assert 0 < osm.read_pbf(spark, str(one))["nodes"].count() < 3000 == osm.read_pbf(spark, path + "/part-*")["nodes"].count()


def test_only_the_kind_that_is_asked_for_is_decoded(spark, extract, tmp_path, monkeypatch):
    osm_pbf.write_pbf(extract, str(tmp_path / "o"))
    reader = osm_pbf._Reader(str(tmp_path / "o"), 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    other = GreaterThan(("id",), 3)
    assert list(reader.pushFilters([EqualTo(("kind",), "way"), other])) == [other]
    assert {k for p in reader.partitions() for b in reader.read(p) for k in b.column(0).to_pylist()} == {"way"}
    assert list(reader.pushFilters([EqualTo(("kind",), "node")])) == [] and [b for p in reader.partitions() for b in reader.read(p)] == []


def test_compressions_and_what_is_no_file(spark, tmp_path):
    block = osm_pbf.encode(pa.RecordBatch.from_pylist([{"kind": "node", "id": 7, "lat": 1.5, "lon": -2.5, "tags": [("a", "b")], "refs": None, "members": None}], schema=osm_pbf._ARROW))
    bodies = {1: block, 4: lzma.compress(block), 5: bz2.compress(block), 6: pa.Codec("lz4_raw").compress(block).to_pybytes(), 7: pa.Codec("zstd").compress(block).to_pybytes()}
    data = b""
    for number, body in bodies.items():
        body = osm_pbf._field(2, len(block)) * (number > 1) + osm_pbf._field(number, body)
        head = osm_pbf._field(1, b"OSMData") + osm_pbf._field(2, b"index") * (number == 4) + osm_pbf._field(3, len(body))
        data += struct.pack(">I", len(head)) + head + body
    (tmp_path / "a.pbf").write_bytes(data)
    got = osm.read_pbf(spark, str(tmp_path / "a.pbf"))["nodes"].collect()
    assert [tuple(r) for r in got] == [(7, 1.5, -2.5, {"a": "b"})] * 5
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert osm.read_pbf(spark, str(tmp_path / "empty.pbf"))["ways"].count() == 0
    with pytest.raises(Exception, match="no file"):
        osm.read_pbf(spark, str(tmp_path / "none.pbf"))["ways"].count()


@pytest.mark.parametrize("kind", ["way", "relation"])
def test_a_block_is_encoded_by_the_column(kind):
    """Against messages put together one by one; that takes some 10 s for each kind, by the column a tenth of one."""
    import time

    rng = random.Random(4)
    rows = []
    for k in range(8000):
        tags = [(t, rng.choice(["x", "é" * 70, ""])) for t in rng.sample("abcd", rng.randrange(3))]
        refs = [rng.randrange(-(10**12), 10**12) for _ in range(rng.randrange(25))]
        members = [{"type": rng.choice(osm_pbf.MEMBER_TYPES), "ref": r, "role": rng.choice([None, "outer"])} for r in refs]
        rows.append({"kind": kind, "id": k * 7 - 100, "tags": tags if k % 5 else None, "refs": refs if kind == "way" and k % 7 else None, "members": members if kind == "relation" and k % 7 else None})
    batch = pa.RecordBatch.from_pylist(rows, schema=osm_pbf._ARROW)
    began = time.process_time()
    block = osm_pbf.encode(batch)
    took = time.process_time() - began
    table, group = (dict(osm_pbf.fields(block))[k] for k in (1, 2))
    strings = [v.decode() for _, v in osm_pbf.fields(table)]
    for row, (number, message) in zip(rows[:500], osm_pbf.fields(group)):
        m = dict(osm_pbf.fields(message))
        assert number == (3 if kind == "way" else 4) and m[1] == row["id"] & (2**64 - 1)
        assert [(strings[a], strings[b]) for a, b in zip(osm_pbf.numbers(m[2]).tolist(), osm_pbf.numbers(m[3]).tolist(), strict=True)] == (row["tags"] or [])
        if kind == "way":
            assert np.cumsum(osm_pbf.signed(osm_pbf.numbers(m[8]))).tolist() == (row["refs"] or [])
        else:
            assert [strings[x] for x in osm_pbf.numbers(m[8]).tolist()] == [x["role"] or "" for x in row["members"] or []]
    back = [x for b in osm_pbf.decode(block) for x in b.column(1).to_pylist()]
    assert back == [r["id"] for r in rows] and took < 2
