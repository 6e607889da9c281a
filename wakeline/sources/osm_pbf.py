"""A data source for .osm.pbf files: files, folders and patterns, read by ranges of bytes.

The driver lists the files and cuts them into ranges. A task finds the first block that begins in its range, by the mark
that every block's header has, and goes on from header to header. A filter on ``kind`` is taken over by the reader: of
blocks without elements of that kind only the group's numbers are looked at. Numbers are decoded by the column."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = (
    "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, "
    "members array<struct<type:string, ref:bigint, role:string>>"
)
MEMBER_TYPES = ("node", "way", "relation")
#: Bytes of a file that one task reads.
RANGE_BYTES = 16 << 20
#: Fixed values of the format: how a block's header begins after its length, the longest header and the longest block, and
#: the kinds of elements by the number of their field in a group.
MARK, HEAD_BYTES, BLOCK_BYTES = b"\x0a\x07OSMData", 64 << 10, 32 << 20
KINDS = {1: "node", 2: "node", 3: "way", 4: "relation"}

_ARROW = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())),
    ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))),
])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers, and bytes for what has a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def numbers(data: bytes) -> np.ndarray:
    """All whole numbers of a packed field, without sign."""
    byte = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(byte < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    size = end - start + 1
    out = np.zeros(len(end), np.uint64)
    for k in range(int(size.max(initial=0))):
        use = size > k
        out[use] |= (byte[start[use] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Whole numbers without sign as a packed field, and the number of bytes of each."""
    left, size = values.astype(np.uint64), np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += left >> np.uint64(7 * k) > 0
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        use = size > k
        out[at[use] + k] = (left[use] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[use] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), size


def signed(values: np.ndarray) -> np.ndarray:
    """Numbers whose sign is their last bit."""
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def _gathered(byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of many stretches in a row."""
    size = end - start
    return byte[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _lists(byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of many packed fields in a row, and len + 1 offsets."""
    data = _gathered(byte, start, end)
    ends = np.concatenate([[0], np.cumsum(data < 128)])
    return numbers(data.tobytes()), ends[np.concatenate([[0], np.cumsum(end - start)])]


def _varints(byte: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that begin at these places, and the places after them."""
    at, value, more = at.copy(), np.zeros(len(at), np.uint64), np.arange(len(at))
    for k in range(10):
        got = byte[at[more]]
        value[more] |= (got & 127).astype(np.uint64) << np.uint64(7 * k)
        at[more] += 1
        more = more[got >= 128]
        if not len(more):
            break
    return value, at


def _split(group: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Where the messages of a group begin and end, by the number of their field."""
    at, size, found = 0, len(group), {}
    while at < size:
        key, at = _varint(group, at)
        if key & 7 == 2:
            length = group[at]
            at += 1
            if length > 127:
                length, at = _varint(group, at - 1)
            found.setdefault(key >> 3, []).append((at, at + length))
            at += length
        elif key & 7 == 0:
            at = _varint(group, at)[1]
        else:
            at += 8 if key & 7 == 1 else 4
    return {n: tuple(np.array(x, np.int64).T) for n, x in found.items()}


def _columns(byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number, start, end) of each field for all messages: one field of each message at a time. The last of a field counts,
    and one that a message lacks is 0 and empty."""
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    live = np.flatnonzero(start < end)
    at = start[live]
    while len(live):
        key, at = _varints(byte, at)
        kind, field = key & np.uint64(7), (key >> np.uint64(3)).astype(np.int64)
        fixed = (kind == 1) | (kind == 5)
        value, after = _varints(byte, np.where(fixed, 0, at))
        begin = np.where(fixed, at, after)
        stop = np.where(kind == 2, after + value.astype(np.int64), np.where(fixed, at + np.where(kind == 1, 8, 4), after))
        for n in np.unique(field).tolist():
            if n not in out:
                out[n] = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            own = field == n
            for into, x in zip(out[n], (value, begin, stop), strict=True):
                into[live[own]] = x[own]
        left = stop < end[live]
        live, at = live[left], stop[left]
    return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running sums within each list."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))


def _table(kind: str, ids: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    made = {"kind": pa.array([kind] * n, pa.string()), "id": pa.array(ids, pa.int64()), **columns}
    return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def _map(strings: pa.Array, offsets: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(keys.astype(np.int64))), strings.take(pa.array(values.astype(np.int64))))


def decode(block: bytes, kinds: frozenset[str] = frozenset(KINDS.values())) -> Iterator[pa.RecordBatch]:
    """The rows of one block of primitives, those of the kinds that are asked for."""
    table, groups, grain, lat0, lon0 = b"", [], 100, 0, 0
    for number, value in fields(block):
        if number == 1:
            table = value
        elif number == 2:
            if value and KINDS.get(_varint(value, 0)[0] >> 3) in kinds:  # a group is of one kind
                groups.append(value)
        elif number == 17:
            grain = value
        elif number in (19, 20):
            value -= (value >> 63) << 64
            lat0, lon0 = (value, lon0) if number == 19 else (lat0, value)
    if not groups:
        return
    strings = pa.array([v.decode() for n, v in fields(table) if n == 1], pa.string())
    degrees = lambda v, base: pa.array((base + grain * v) / 1e9)
    for group in groups:
        byte = np.frombuffer(group + bytes(10), np.uint8)
        for number, (start, end) in _split(group).items():
            if number == 2:
                for i, j in zip(start.tolist(), end.tolist(), strict=True):
                    m = dict(fields(group[i:j]))
                    if not m.get(1):
                        continue
                    ids, lat, lon = (np.cumsum(signed(numbers(m[k]))) for k in (1, 8, 9))
                    flat = numbers(m.get(10, b""))
                    if len(flat):  # key, value, key, value, 0 for each node
                        stop = np.flatnonzero(flat == 0)[: len(ids)]
                        pair = np.delete(flat, stop).reshape(-1, 2).T
                        at = np.concatenate([[0], (stop - np.arange(len(stop))) // 2])
                    else:
                        pair, at = np.zeros((2, 0), np.uint64), np.zeros(len(ids) + 1, np.int64)
                    yield _table("node", ids, lat=degrees(lat, lat0), lon=degrees(lon, lon0), tags=_map(strings, at, *pair))
            if number not in (1, 3, 4):
                continue
            found = _columns(byte, start, end)
            none = (np.zeros(len(start), np.uint64), *(np.zeros(len(start), np.int64) for _ in range(2)))
            value = lambda k: found.get(k, none)[0]  # noqa: E731, B023
            lists = lambda k: _lists(byte, *found.get(k, none)[1:])  # noqa: E731, B023
            keys, at = lists(2)
            tags = _map(strings, at, keys, lists(3)[0])
            if number == 1:
                yield _table("node", signed(value(1)), lat=degrees(signed(value(8)), lat0), lon=degrees(signed(value(9)), lon0), tags=tags)
                continue
            refs, at = lists(8 if number == 3 else 9)
            refs, offsets = pa.array(_sums(signed(refs), at)), pa.array(at, pa.int32())
            if number == 3:
                yield _table("way", value(1).view(np.int64), tags=tags, refs=pa.ListArray.from_arrays(offsets, refs))
                continue
            roles, types = (lists(k)[0].astype(np.int64) for k in (8, 10))
            members = pa.StructArray.from_arrays([pa.array(MEMBER_TYPES).take(pa.array(types)), refs, strings.take(pa.array(roles))], ["type", "ref", "role"])
            yield _table("relation", value(1).view(np.int64), tags=tags, members=pa.ListArray.from_arrays(offsets, members))


def unpacked(blob: dict, where: str) -> bytes:
    """What a blob holds, by the number of the field that it is in."""
    if 1 in blob:
        return blob[1]
    if 3 in blob:
        return zlib.decompress(blob[3])
    if 4 in blob:
        return lzma.decompress(blob[4])
    if 5 in blob:
        return bz2.decompress(blob[5])
    if 6 in blob or 7 in blob:
        return pa.Codec("lz4_raw" if 6 in blob else "zstd").decompress(blob[6 if 6 in blob else 7], blob[2]).to_pybytes()
    raise ValueError(f"{where}: compression is not supported")


def store_of(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    if path.startswith("file:") and "://" not in path:
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, str, int]]:
    """(address, path in its store, size) of the files of a path: a file, all *.pbf files below a folder, or those that a
    pattern with * or ? names. A path that names nothing is an error."""
    import fnmatch

    from pyarrow import fs

    store, inner = store_of(path)
    fixed = inner
    while any(c in fixed for c in "*?["):
        fixed = fixed.rpartition("/")[0]
    info = store.get_file_info(fixed or "/")
    if fixed != inner or info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(fixed or "/", recursive=True))
        wanted = [x for x in found if x.type == fs.FileType.File and (fnmatch.fnmatch(x.path, inner) if fixed != inner else x.path.endswith(".pbf"))]
    else:
        wanted = [info] if info.type == fs.FileType.File else []
    if not wanted:
        raise FileNotFoundError(f"no file at {path}")
    return [(path, x.path, x.size) for x in sorted(wanted, key=lambda x: x.path)]


class _Range(InputPartition):
    def __init__(self, base: str, path: str, start: int, end: int) -> None:
        self.base, self.path, self.start, self.end = base, path, start, end


def _first_block(file, start: int, size: int) -> int:
    """Where the first block begins at or after a place of a file: four bytes before the mark of a header that is whole."""
    at, step, held = start, 1 << 20, b""
    while at < size:
        file.seek(at)
        held = held[-(len(MARK) + 3) :] + file.read(min(step, size - at))
        at = file.tell()
        k = held.find(MARK, 4)
        while k >= 0:
            length = struct.unpack(">I", held[k - 4 : k])[0]
            place = at - len(held) + k - 4
            if len(MARK) < length <= HEAD_BYTES and place >= start:
                file.seek(place + 4)
                try:
                    header = dict(fields(file.read(length)))
                except IndexError:
                    header = {}
                if header.get(1) == b"OSMData" and 0 < header.get(3, 0) <= BLOCK_BYTES and place + 4 + length + header[3] <= size:
                    return place
            k = held.find(MARK, k + 1)
    return size


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes, self.kinds = path, range_bytes, frozenset(KINDS.values())

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                self.kinds &= frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            else:
                yield f

    def partitions(self) -> list[_Range]:
        if not self.kinds:
            return [_Range(self.path, "", 0, 0)]
        return [_Range(base, path, at, min(at + self.range_bytes, size)) for base, path, size in listed(self.path) for at in range(0, max(size, 1), self.range_bytes)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with store_of(partition.base)[0].open_input_file(partition.path) as file:
            size = file.size()
            at = _first_block(file, partition.start, size) if partition.start or size else size
            while at < partition.end:
                file.seek(at)
                head = struct.unpack(">I", file.read(4))[0]
                header = dict(fields(file.read(head)))
                if header.get(1) == b"OSMData":
                    yield from decode(unpacked(dict(fields(file.read(header[3]))), f"block at {at} of {partition.path}"), self.kinds)
                at += 4 + head + header[3]


class OsmPbf(DataSource):
    """Options: path, and range_bytes, the bytes of a file that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


# writing


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return packed(np.array([number << 3, value & (2**64 - 1)], np.uint64))[0]
    return packed(np.array([number << 3 | 2, len(value)], np.uint64))[0] + value


def blob(kind: bytes, data: bytes) -> bytes:
    """A block of a file, compressed."""
    body = _field(2, len(data)) + _field(3, zlib.compress(data, 6))
    head = _field(1, kind) + _field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def _joined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row by row what several columns of bytes (all bytes, len + 1 offsets) hold, as such a column."""
    sizes = [np.diff(at) for _, at in parts]
    ends = np.concatenate([[0], np.cumsum(sum(sizes))])
    out, place = np.empty(int(ends[-1]), np.uint8), ends[:-1].copy()
    for (data, at), size in zip(parts, sizes, strict=True):
        out[np.repeat(place - at[:-1], size) + np.arange(len(data))] = data
        place += size
    return out, ends


def _varint_column(values: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number in each row, or, given offsets, a list of them."""
    data, size = packed(values)
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.frombuffer(data, np.uint8), ends if at is None else ends[at]


def _field_column(number: int, column: tuple[np.ndarray, np.ndarray], sized: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """The parts of a field in each row: its key, its length unless it is a number, and the value."""
    rows = len(column[1]) - 1
    key = np.full(rows, number << 3 | (2 if sized else 0), np.uint8), np.arange(rows + 1)
    return [key, *([_varint_column(np.diff(column[1]))] if sized else []), column]


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())]).astype(np.int64)


def _steps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Differences to the value before, within each list to 0 at its start."""
    out = np.diff(values, prepend=0)
    first = offsets[:-1][np.diff(offsets) > 0]
    out[first] = values[first]
    return out


def encode(rows: pa.RecordBatch) -> bytes:
    """The block of rows (kind, id, lat, lon, tags, refs, members), grouped by kind; places to 1e-7 degrees."""
    own = {kind: rows.filter(pa.compute.equal(rows.column(0), kind)) for kind in MEMBER_TYPES}
    own = {kind: x for kind, x in own.items() if len(x)}
    pairs = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    tags = {kind: x.column(4).cast(pairs).flatten() for kind, x in own.items()}
    text = {kind: [x.field(k) for k in (0, 1)] for kind, x in tags.items()}
    if "relation" in own:
        text["relation"].append(own["relation"].column(6).flatten().field("role").fill_null(""))
    flat = [x for found in text.values() for x in found]
    strings = pa.concat_arrays([x.cast(pa.string()) for x in flat]).dictionary_encode() if flat else pa.array([], pa.string()).dictionary_encode()
    cuts = np.cumsum([len(x) for x in flat])[:-1]
    of = iter(np.split(strings.indices.to_numpy().astype(np.int64) + 1, cuts))  # in the table, after an empty one
    groups = []
    for kind, x in own.items():
        ids, tag_at = x.column(1).to_numpy(), _offsets(x.column(4).cast(pairs))
        keys, values = next(of), next(of)
        if kind == "node":
            places = [packed(unsigned(np.diff(np.round(x.column(k).to_numpy() * 1e7).astype(np.int64), prepend=0)))[0] for k in (2, 3)]
            dense = _field(1, packed(unsigned(np.diff(ids, prepend=0)))[0]) + _field(8, places[0]) + _field(9, places[1])
            if len(keys):
                flat, at = np.zeros(2 * len(keys) + len(ids), np.int64), 2 * np.arange(len(keys)) + np.repeat(np.arange(len(ids)), np.diff(tag_at))
                flat[at], flat[at + 1] = keys, values
                dense += _field(10, packed(flat)[0])
            groups.append(_field(2, dense))
            continue
        lists = x.column(5 if kind == "way" else 6)
        at, flat = _offsets(lists), lists.flatten()
        refs = _varint_column(unsigned(_steps((flat if kind == "way" else flat.field("ref")).to_numpy(), at)), at)
        message = _field_column(1, _varint_column(ids), sized=False) + _field_column(2, _varint_column(keys, tag_at)) + _field_column(3, _varint_column(values, tag_at))
        if kind == "relation":
            types = pa.compute.index_in(flat.field("type"), value_set=pa.array(MEMBER_TYPES)).to_numpy()
            message += _field_column(8, _varint_column(next(of), at)) + _field_column(9, refs) + _field_column(10, _varint_column(types, at))
        else:
            message += _field_column(8, refs)
        groups.append(_joined(*_field_column(3 if kind == "way" else 4, _joined(*message)))[0].tobytes())
    return _field(1, b"".join(_field(1, s.encode()) for s in ("", *strings.dictionary.to_pylist()))) + b"".join(_field(2, g) for g in groups)


def write_pbf(tables: dict[str, DataFrame], path: str, block_rows: int = 8000) -> int:
    """Writes nodes (id, lat, lon, tags), ways (id, refs, tags) and relations (id, members, tags) to a folder of .osm.pbf files,
    each whole by itself, and returns how many. A file appears under its name when it is complete, so a task that is run
    again replaces it by the same. ``path`` is one that all machines reach."""
    from pyspark.sql import functions as F

    def rows(df: DataFrame, kind: str) -> DataFrame:
        types = dict(c.split(" ", 1) for c in SCHEMA.split(", ", 6))
        return df.select(F.lit(kind).alias("kind"), *((F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in _ARROW.names[1:]))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get()
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        name, open_name = f"{folder}/part-{own.partitionId():05d}.osm.pbf", f"{folder}/.open-{own.partitionId():05d}-{own.taskAttemptId()}"
        blocks = 0
        with store.open_output_stream(open_name) as out:
            out.write(blob(b"OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes")))
            for b in batches:
                for i in range(0, len(b), block_rows):
                    out.write(blob(b"OSMData", encode(b.slice(i, block_rows))))
                    blocks += 1
        if blocks:
            store.move(open_name, name)
        else:
            store.delete_file(open_name)
        yield pa.RecordBatch.from_arrays([pa.array([min(blocks, 1)])], ["n"])

    every = rows(tables["nodes"], "node").unionByName(rows(tables["ways"], "way")).unionByName(rows(tables["relations"], "relation"))
    return every.mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
