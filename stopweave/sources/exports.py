"""Text outputs: queries for map extracts, GeoJSON, run statistics and score reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopweave.operators.rules import Rule
from stopweave.operators.spatial import Box

_KINDS = {"node": 16, "way": 8, "relation": 4}


def overpass(boxes: Iterable[Box], keep: Iterable[Rule]) -> str:
    """A query for all that the rules keep within the boxes, with what ways and relations hold."""
    parts = []
    for box in boxes:
        place = ",".join(f"{v:.7f}" for v in box)
        for kind, skip in _KINDS.items():
            for r in keep:
                if not r.flags & skip:
                    test = f'["{r.key}"]' if r.value == "*" else f'["{r.key}"="{r.value}"]'
                    parts.append(f"  {kind}{test}({place});")
    return "[out:xml];\n(\n" + "\n".join(parts) + "\n);\n(._;>;);\nout;\n"


def osmfilter(keep: Iterable[Rule], drop: Iterable[Rule]) -> str:
    """Parameters of a tag filter tool."""
    one = lambda r: r.key if r.value == "*" else f"{r.key}={r.value}"
    return "--keep=\n" + " or\n".join(map(one, keep)) + "\n--drop=\n" + " or\n".join(map(one, drop)) + "\n"


def feature(points: Column, properties: Column, kind: str = "LineString") -> Column:
    """A GeoJSON feature of an array of structs with lat and lon."""
    coordinates = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    if kind == "Point":
        coordinates = F.get(coordinates, 0)
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write_geojson(features: DataFrame, path: str) -> None:
    """A collection of the first column's features; rows stream to the file."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i, row in enumerate(features.toLocalIterator()):
            f.write(("," if i else "") + "\n" + row[0])
        f.write("\n]}\n")


def graph_features(edges: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """GeoJSON features of a routing graph: a line for every edge, a point for every station."""
    ends = F.array(*(F.struct(F.col(f"lat{n}").alias("lat"), F.col(f"lon{n}").alias("lon")) for n in (1, 2)))
    about = [c for c in ("eid", "src", "dst", "lvl", "oneway", "cost", "lines") if c in edges.columns]
    rows = edges.select(feature(ends, F.struct(*about)).alias("feature"))
    if stations is None:
        return rows
    place = F.array(F.struct("lat", "lon"))
    named = F.struct(F.col("nid"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "track")))
    return rows.unionByName(stations.select(feature(place, named, "Point").alias("feature")))


def trie_dot(nodes: DataFrame) -> DataFrame:
    """Lines of a DOT graph of a prefix trie (prefix, parent, n_trips)."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\\\$1"), F.lit('"'))
    line = F.concat(quoted(F.col("parent")), F.lit(" -> "), quoted(F.col("prefix")), F.lit(' [label="'), F.col("n_trips").cast("string"), F.lit('"];'))
    return nodes.select(line.alias("line"))


def run_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: sizes of the tables that a run made, as ``num_<name>``."""
    counts = [df.agg(F.count(F.lit(1)).alias(f"num_{name}")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c)  # one row each
    return out


def score_report(summary: DataFrame, style: str = "text") -> str:
    """The single row of a score summary, for people (text, short) or programs (json)."""
    row = summary.first().asDict()
    if style == "json":
        return json.dumps(row)
    if style == "short":
        return "\t".join(str(v) for v in row.values())
    return "\n".join(f"{k}: {v}" for k, v in row.items())
