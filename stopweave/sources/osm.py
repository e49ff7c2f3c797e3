"""OpenStreetMap files as DataFrames of nodes, ways and relations, and back.

XML is read by Spark's own reader, split by entity. PBF goes through a Python data source with one partition
for each blob, so that a planet file is decoded by all executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TAG = "array<struct<_k:string,_v:string>>"
_XML = {
    "node": f"_id long, _lat double, _lon double, tag {_TAG}",
    "way": f"_id long, nd array<struct<_ref:long>>, tag {_TAG}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag {_TAG}",
}
MEMBER = "struct<type:string,ref:long,role:string>"
SCHEMAS = {
    "node": "id long, lat double, lon double, tags map<string,string>",
    "way": "id long, nds array<long>, tags map<string,string>",
    "relation": f"id long, members array<{MEMBER}>, tags map<string,string>",
}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, ways and relations of a file, by its ending: .osm (.gz, .bz2), .xml or .pbf."""
    if path.endswith(".pbf"):
        spark.dataSource.register(PbfSource)
        return {k: spark.read.format("osm_pbf").option("kind", k).load(path) for k in SCHEMAS}
    if path.endswith((".osm", ".xml", ".osm.gz", ".osm.bz2", ".xml.gz", ".xml.bz2")):
        return {k: read_xml(spark, path, k) for k in SCHEMAS}
    raise ValueError(f"{path}: format not supported")


def read_xml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", kind).schema(_XML[kind]).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast(_TAG)), lambda t: F.struct(t["_k"], t["_v"])))
    if kind == "node":
        return rows.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags.alias("tags"))
    if kind == "way":
        return rows.select(F.col("_id").alias("id"), F.coalesce(F.col("nd._ref"), F.array().cast("array<long>")).alias("nds"), tags.alias("tags"))
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return rows.select(F.col("_id").alias("id"), F.coalesce(members, F.array().cast(f"array<{MEMBER}>")).alias("members"), tags.alias("tags"))


def bounds_xml(spark: SparkSession, path: str) -> tuple[float, float, float, float]:
    """minlat, minlon, maxlat, maxlon; a file without them is an error."""
    schema = "_minlat double, _minlon double, _maxlat double, _maxlon double"
    row = spark.read.format("xml").option("rowTag", "bounds").schema(schema).load(path).first()
    if row is None or None in tuple(row):
        raise ValueError(f"{path}: no bounds")
    return tuple(row)


# --- protocol buffers -------------------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field: an integer, or the bytes of anything with a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append(v)
    return out


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _sums(values: Iterable[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += _zigzag(v)
        out.append(total)
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """Kind, offset and length of each blob, from the headers alone."""
    with open(path, "rb") as f:
        while head := f.read(4):
            fields = dict(_fields(f.read(struct.unpack(">I", head)[0])))
            yield bytes(fields[1]).decode(), f.tell(), int(fields[3])
            f.seek(int(fields[3]), 1)


def unpack(blob: bytes) -> bytes:
    fields = dict(_fields(blob))
    if 1 in fields:
        return bytes(fields[1])
    if 3 in fields:
        return zlib.decompress(fields[3])
    raise ValueError("only raw and zlib blobs can be read")


def entities(block: bytes, kind: str) -> Iterator[tuple]:
    """Rows of one kind of a data block."""
    strings: list[str] = []
    groups, gran, lat0, lon0 = [], 100, 0, 0
    for n, v in _fields(block):
        if n == 1:
            strings = [bytes(s).decode("utf-8", "replace") for _, s in _fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            gran = v
        elif n == 19:
            lat0 = _signed(v)
        elif n == 20:
            lon0 = _signed(v)
    degrees = lambda base, v: round((base + gran * v) * 1e-9, 9)
    tags_of = lambda f: {strings[k]: strings[v] for k, v in zip(_packed(f.get(2, b"")), _packed(f.get(3, b"")), strict=True)}
    for group in groups:
        for n, v in _fields(group):
            if n == 1 and kind == "node":
                f = dict(_fields(v))
                yield _zigzag(f[1]), degrees(lat0, _zigzag(f[8])), degrees(lon0, _zigzag(f[9])), tags_of(f)
            elif n == 2 and kind == "node":
                f = dict(_fields(v))
                ids, lats, lons = (_sums(_packed(f[k])) for k in (1, 8, 9))
                pairs = iter(_packed(f.get(10, b"")))
                for i, la, lo in zip(ids, lats, lons, strict=True):
                    tags = {}
                    for k in pairs:
                        if not k:
                            break
                        tags[strings[k]] = strings[next(pairs)]
                    yield i, degrees(lat0, la), degrees(lon0, lo), tags
            elif n == 3 and kind == "way":
                f = dict(_fields(v))
                yield f[1], _sums(_packed(f.get(8, b""))), tags_of(f)
            elif n == 4 and kind == "relation":
                f = dict(_fields(v))
                names = ("node", "way", "relation")
                roles, refs, types = _packed(f.get(8, b"")), _sums(_packed(f.get(9, b""))), _packed(f.get(10, b""))
                members = [(names[t], r, strings[s]) for t, r, s in zip(types, refs, roles, strict=True)]
                yield f[1], members, tags_of(f)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "node")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PbfReader(self.options["path"].removeprefix("file:"), self.options.get("kind", "node"))


class Blob(InputPartition):
    def __init__(self, offset: int, size: int) -> None:
        self.offset, self.size = offset, size


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def partitions(self) -> list[Blob]:
        return [Blob(o, n) for kind, o, n in blobs(self.path) if kind == "OSMData"]

    def read(self, partition: Blob) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            yield from entities(unpack(f.read(partition.size)), self.kind)


def _put(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value & (1 << 64) - 1)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _number(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def _deltas(values: Iterable[int]) -> bytes:
    out, last = b"", 0
    for v in values:
        d = v - last
        last = v
        out += _number((d << 1) ^ (d >> 63))
    return out


def _block(kind: str, rows: list) -> bytes:
    """A data block of one group."""
    strings: dict[str, int] = {"": 0}
    at = lambda s: strings.setdefault(s, len(strings))
    if kind == "node":
        scaled = lambda v: round(v * 1e7)
        pairs = b"".join(b"".join(_number(at(k)) + _number(at(v)) for k, v in sorted(r.tags.items())) + b"\0" for r in rows)
        group = _put(2, _put(1, _deltas(r.id for r in rows)) + _put(8, _deltas(scaled(r.lat) for r in rows)) + _put(9, _deltas(scaled(r.lon) for r in rows)) + _put(10, pairs))
    else:
        group = b""
        for r in rows:
            items = sorted(r.tags.items())
            body = _put(1, r.id) + _put(2, b"".join(_number(at(k)) for k, _ in items)) + _put(3, b"".join(_number(at(v)) for _, v in items))
            if kind == "way":
                group += _put(3, body + _put(8, _deltas(r.nds)))
            else:
                names = ("node", "way", "relation")
                roles = b"".join(_number(at(m.role)) for m in r.members)
                types = bytes(names.index(m.type) for m in r.members)
                group += _put(4, body + _put(8, roles) + _put(9, _deltas(m.ref for m in r.members)) + _put(10, types))
    table = b"".join(_put(1, s.encode()) for s in strings)
    return _put(1, table) + _put(2, group)


def _blob(kind: str, body: bytes) -> bytes:
    blob = _put(2, len(body)) + _put(3, zlib.compress(body))
    head = _put(1, kind.encode()) + _put(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def write_pbf(tables: dict[str, DataFrame], path: str, rows: int = 8000) -> None:
    """One file; entities stream to the driver in blocks of ``rows``, by id."""
    with open(path, "wb") as f:
        f.write(_blob("OSMHeader", _put(4, b"OsmSchema-V0.6") + _put(4, b"DenseNodes")))
        for kind in SCHEMAS:
            held: list = []
            for row in tables[kind].orderBy("id").toLocalIterator():
                held.append(row)
                if len(held) == rows:
                    f.write(_blob("OSMData", _block(kind, held)))
                    held = []
            if held:
                f.write(_blob("OSMData", _block(kind, held)))


def write_xml(tables: dict[str, DataFrame], path: str, bounds: tuple[float, float, float, float] | None = None) -> None:
    """One file, coordinates with seven digits."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<osm>\n')
        if bounds:
            f.write('<bounds minlat="{:.7f}" minlon="{:.7f}" maxlat="{:.7f}" maxlon="{:.7f}"/>\n'.format(*bounds))
        for kind in SCHEMAS:
            for r in tables[kind].orderBy("id").toLocalIterator():
                place = f' lat="{r.lat:.7f}" lon="{r.lon:.7f}"' if kind == "node" else ""
                f.write(f'<{kind} id="{r.id}"{place}>')
                if kind == "way":
                    f.writelines(f'<nd ref="{n}"/>' for n in r.nds)
                if kind == "relation":
                    f.writelines(f'<member type="{m.type}" ref="{m.ref}" role={quoteattr(m.role or "")}/>' for m in r.members)
                f.writelines(f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in sorted(r.tags.items()))
                f.write(f"</{kind}>\n")
        f.write("</osm>\n")
