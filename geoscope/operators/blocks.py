"""Zones met by the observations around them, block by block.

A join by cell makes a row for each zone and cell or coordinate, and hashed cells scatter a zone's rows over all
tasks, so nothing collapses before the shuffle. Here zones and observations are laid on blocks of ``BLOCK`` degrees:
Spark brings the rows of a block together, sorted, observations first and by latitude, and a task reads them as a
stream. It holds the observations of one block at a time (crowded blocks are dealt over salts, so these are
at most some ``zones.CROWDED``) and looks at one zone after the other with numpy. A zone leaves a task as its summary
over the block. So what is shuffled are the observations once, a zone once for each block that it touches, and
one summary for each of these.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from geoscope.operators.zones import SLACK, dealt, touched_cells, with_cell

#: Blocks are this wide and high, in degrees.
BLOCK = 8.0
#: Zones up to which a task has enough work, and result rows that leave a task at once.
ZONES_A_TASK, ROWS_AT_ONCE = 200, 1 << 16

Columns = dict[str, np.ndarray]
#: The observations of a block, a zone (a row of Arrow columns) and its place in them: the zone's result columns.
Work = Callable[[Columns, Columns, int], Columns | None]

_KEY = ("cy", "cx", "salt")


def tasks(zones: DataFrame) -> int:
    """Tasks for so many zones: their number grows with the work, whatever the bytes of the zones' rows."""
    spark = zones.sparkSession
    enough = math.ceil(zones.count() / ZONES_A_TASK)
    return max(enough, spark.sparkContext.defaultParallelism)


def inside(block: Columns, lat: float, lon: float, radius: float, shape: str) -> np.ndarray:
    """Places of the block's observations that lie in the zone; the same arithmetic as :func:`zones.in_zone`."""
    y, x = block["reclat"], block["reclong"]
    first, last = np.searchsorted(y, lat - radius - SLACK), np.searchsorted(y, lat + radius + SLACK, "right")
    y, x = y[first:last], x[first:last]
    if shape == "box":
        found = (y >= lat - radius) & (y <= lat + radius) & (x >= lon - radius) & (x <= lon + radius)
    else:
        dy, dx = y - lat, x - lon
        found = np.sqrt(dy * dy + dx * dx) <= radius
    return first + np.flatnonzero(found)


def coded(block: Columns, *names: str) -> tuple[np.ndarray, Columns]:
    """A number for each observation's values in these columns, and the values by number; found once a block."""
    kept = "code of " + " ".join(names)
    if kept not in block:
        codes = np.zeros(len(block["reclat"]), np.int64)
        for name in names:
            own, values = pd.factorize(block[name], use_na_sentinel=False)
            codes = codes * len(values) + own
        _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
        block[kept] = (codes, {name: block[name][first] for name in names})
    return block[kept]


def zone_groups(by: Sequence[str], shape: str, match: str | None = None) -> Work:
    """Sums of ``n`` for each value of ``by`` in a zone; of observations that agree with the zone in ``match`` only."""

    def work(block, zones, at):
        found = inside(block, *(zones[c][at] for c in ("lat", "lon", "radius")), shape)
        if match:
            found = found[block[match][found] == zones[match][at]]
        codes, values = coded(block, *by)
        seen, place = np.unique(codes[found], return_inverse=True)
        n = np.bincount(place, weights=block["n"][found], minlength=len(seen)).astype(np.int64)
        return {**{c: v[seen] for c, v in values.items()}, "n": n}

    return work


def grouped(block: Columns, *names: str) -> tuple[Columns, Columns]:
    """The observations of a block by their values in these columns, with where each group starts, its extent and its sum
    of ``n``, and the values by group; found once a block."""
    kept = "groups of " + " ".join(names)
    if kept not in block:
        codes, values = coded(block, *names)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        y, x, n = (block[c][order] for c in ("reclat", "reclong", "n"))
        found = {"y": y, "x": x, "n": n, "start": starts, "size": np.diff(starts, append=len(y)), "sum": np.add.reduceat(n, starts)}
        for name, v in (("y", y), ("x", x)):
            found[f"{name}_lo"], found[f"{name}_hi"] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        block[kept] = (found, values)
    return block[kept]


def zone_compact_groups(by: Sequence[str], shape: str, total: bool = False) -> Work:
    """As :func:`zone_groups`, or the ``total`` of all groups, for values of ``by`` that go with places, such as cells.

    A group whose extent lies in the zone counts as a whole, and one whose extent lies outside not at all. The tests of
    an extent are those of its observations at its farthest and nearest corner, and rounding keeps their order, so
    only groups on the rim are looked at one by one."""

    def work(block, zones, at):
        lat, lon, radius = (zones[c][at] for c in ("lat", "lon", "radius"))
        g, values = grouped(block, *by)
        if shape == "box":
            south, north, west, east = lat - radius, lat + radius, lon - radius, lon + radius
            whole = (g["y_lo"] >= south) & (g["y_hi"] <= north) & (g["x_lo"] >= west) & (g["x_hi"] <= east)
            none = (g["y_hi"] < south) | (g["y_lo"] > north) | (g["x_hi"] < west) | (g["x_lo"] > east)
        else:
            ends = [(g[f"{c}_lo"] - centre, g[f"{c}_hi"] - centre) for c, centre in (("y", lat), ("x", lon))]
            (dy, dx), (by_y, by_x) = ([f(low, high) for low, high in ends] for f in (_farthest, _nearest))
            whole, none = np.sqrt(dy * dy + dx * dx) <= radius, np.sqrt(by_y * by_y + by_x * by_x) > radius
        n = np.where(whole, g["sum"], 0)
        rim = np.flatnonzero(~whole & ~none)
        if len(rim):
            sizes = g["size"][rim]
            owner = np.repeat(rim, sizes)
            place = np.arange(len(owner)) + np.repeat(g["start"][rim] - np.cumsum(sizes) + sizes, sizes)
            y, x = g["y"][place], g["x"][place]
            if shape == "box":
                found = (y >= south) & (y <= north) & (x >= west) & (x <= east)
            else:
                dy, dx = y - lat, x - lon
                found = np.sqrt(dy * dy + dx * dx) <= radius
            n += np.bincount(owner[found], weights=g["n"][place[found]], minlength=len(n)).astype(np.int64)
        seen = np.flatnonzero(n)
        if total:
            return {"total": n[seen].sum(keepdims=True)} if len(seen) else None
        return {**{c: v[seen] for c, v in values.items()}, "n": n[seen]}

    return work


def _farthest(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(np.abs(low), np.abs(high))


def _nearest(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(low, -high), 0.0)


def zone_extent(value: str, shape: str) -> Work:
    """The least and largest value in a zone, and the sum of ``n``."""

    def work(block, zones, at):
        found = inside(block, *(zones[c][at] for c in ("lat", "lon", "radius")), shape)
        if not len(found):
            return None
        v = block[value][found]
        return {"lo": np.fmin.reduce(v, keepdims=True), "hi": v.max(keepdims=True), "total": block["n"][found].sum(keepdims=True)}

    return work


def zone_bins(value: str, bins: int, shape: str) -> Work:
    """Sums of ``n`` for each of the equal bins between the zone's ``lo`` and ``hi``."""

    def work(block, zones, at):
        found = inside(block, *(zones[c][at] for c in ("lat", "lon", "radius")), shape)
        lo, hi = zones["lo"][at], zones["hi"][at]
        place = np.zeros(len(found), np.int64)
        if hi > lo:
            place = np.minimum(np.floor((block[value][found] - lo) / (hi - lo) * bins), bins - 1).astype(np.int64)
        n = np.bincount(place, weights=block["n"][found], minlength=bins).astype(np.int64)
        seen = np.unique(place)
        return {"bin": seen, "n": n[seen]}

    return work


_REDUCE = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def zone_measures(by: str, measures: dict[str, str], shape: str) -> Work:
    """Measures of the observations of a zone for each value of ``by``, as doubles: not a number where all are null."""

    def work(block, zones, at):
        found = inside(block, *(zones[c][at] for c in ("lat", "lon", "radius")), shape)
        if not len(found):
            return None
        codes, values = coded(block, by)
        order = np.argsort(codes[found], kind="stable")
        found = found[order]
        seen, starts = np.unique(codes[found], return_index=True)
        out = {by: values[by][seen]}
        for name, how in measures.items():
            v = block[name][found].astype(np.float64)
            known = ~np.isnan(v)
            neutral = {"sum": 0.0, "min": np.inf, "max": -np.inf}[how]
            reduced = _REDUCE[how].reduceat(np.where(known, v, neutral), starts)
            out[name] = np.where(np.logical_or.reduceat(known, starts), reduced, np.nan)
        return out

    return work


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _streamed(points: list[str], zones: list[str], keep: list[str], work: Work, schema: pa.Schema, batches) -> Iterator[pa.RecordBatch]:
    parts: list[pa.RecordBatch] = []
    block: Columns | None = None
    now = None
    out: list[Columns] = []
    kept: list[pa.RecordBatch] = []
    rows = 0

    def flushed() -> pa.RecordBatch:
        whole = pa.Table.from_batches([r.select(keep) for r in kept]).combine_chunks() if keep else None
        sizes = [len(next(iter(found.values()))) for found in out]
        owner = np.repeat(np.arange(len(out)), sizes)
        columns = []
        for field in schema:
            if field.name in keep:
                columns.append(whole.column(field.name).combine_chunks().take(pa.array(owner)).cast(field.type))
            elif pa.types.is_list(field.type):
                grid = np.concatenate([found[field.name] for found in out])
                ends = np.arange(0, grid.size + 1, grid.shape[1], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(grid.ravel())).cast(field.type))
            else:
                columns.append(pa.array(np.concatenate([found[field.name] for found in out]), field.type))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        is_zone = _numpy(batch.column("is_zone"))
        marks = np.stack([*(_numpy(batch.column(k)) for k in _KEY), is_zone])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key, part = tuple(marks[:3, a]), batch.slice(a, b - a)
            if key != now:
                now, parts, block = key, [], None
            if not is_zone[a]:
                parts.append(part)
                continue
            if block is None:
                block = {c: np.concatenate([_numpy(p.column(c)) for p in parts]) if parts else np.zeros(0) for c in points}
                parts = []
            if not len(block["reclat"]):
                continue
            asked = {c: _numpy(part.column(c)) for c in zones}
            for at in range(part.num_rows):
                found = work(block, asked, at)
                size = len(next(iter(found.values()))) if found else 0
                if size:
                    out.append(found)
                    kept.append(part.slice(at, 1))
                    rows += size
                    if rows >= ROWS_AT_ONCE:
                        yield flushed()
                        out, kept, rows = [], [], 0
    if out:
        yield flushed()


def met_in_blocks(
    points: DataFrame,
    zones: DataFrame,
    work: Work,
    result: str,
    keep: Sequence[str] = ("location_id",),
    shape: str = "radius",
    reach: Column | None = None,
    number: int | None = None,
    size: float = BLOCK,
) -> DataFrame:
    """The rows that ``work`` finds for each zone in each block it touches, with the zone's columns ``keep``.

    ``points`` has reclat, reclong and numbers; ``zones`` location_id, lat, lon, radius and more. ``result`` is the
    schema of what ``work`` returns. A zone reaches ``reach`` degrees (default: its radius). ``number`` of tasks:
    by default as many as :func:`tasks` says, which counts the zones.
    """
    number = number or tasks(zones)
    wide = zones.withColumn("_own", F.col("radius")).withColumn("radius", F.col("radius") if reach is None else reach + SLACK)
    cells = touched_cells(wide, size, shape).withColumn("radius", F.col("_own")).drop("_own")
    listed = with_cell(points, size)
    listed, cells = dealt(listed, cells, size)
    together = listed.withColumn("is_zone", F.lit(False)).unionByName(cells.withColumn("is_zone", F.lit(True)), allowMissingColumns=True)
    ordered = together.repartition(number, *_KEY).sortWithinPartitions(*_KEY, "is_zone", "reclat")
    ddl = ", ".join([*(f"`{c}` {zones.schema[c].dataType.simpleString()}" for c in keep), result])
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    point_columns, kept_columns = list(points.columns), list(keep)
    zone_columns = [c for c in zones.columns if c != "location_id"]

    def run(batches):
        return _streamed(point_columns, zone_columns, kept_columns, work, schema, batches)

    return ordered.mapInArrow(run, ddl)
