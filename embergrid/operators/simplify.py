"""Simplification of polygon borders by distance, with common borders kept common.

A border is cut where polygons meet, and each arc between two cuts is simplified by itself: of its
vertices those stay that lie farther than the tolerance from the line between the ones kept around
them, the farthest first (Douglas-Peucker). An arc has one shape for all polygons that it bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embergrid.operators.geometry import COORDINATES
from embergrid.operators.skew import lookup_join
from embergrid.session import scratch_path

# One of so many vertices is a cut wherever it lies, which bounds the arcs of borders of any length.
PIECE = 4096
# Edges of a ring that one window holds.
BLOCK = 65_536

# Steps of a degree that tell vertices apart when some are chosen as cuts, and odd factors to mix them.
_STEPS = 1_000_000
_FACTORS = (73_856_093, 19_349_663)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder, so that several uses do not compute them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chosen(x: Column, y: Column, piece: int) -> Column:
    """Whether a vertex is a cut by its place alone, so that all borders through it are cut there."""
    steps = [F.floor(number * F.lit(float(_STEPS))).cast("bigint") * F.lit(factor) for number, factor in zip((x, y), _FACTORS)]
    return F.pmod(steps[0].bitwiseXOR(steps[1]), F.lit(piece)) == 0


def _junctions(edges: DataFrame) -> DataFrame:
    """``x1, y1, cut``: vertices with other than two neighbours, and those where a ring is open.

    Neighbours are distinct places, so copies of a polygon make no junction.
    """
    x1, y1, x2, y2 = (F.col(name) for name in COORDINATES)
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(x1.alias("x"), y1.alias("y"), x2.alias("nx"), y2.alias("ny"), F.lit(1).alias("turn")),
                F.struct(x2.alias("x"), y2.alias("y"), x1.alias("nx"), y1.alias("ny"), F.lit(-1).alias("turn")),
            )
        )
    )
    ways = ends.groupBy("x", "y", "nx", "ny").agg(F.sum("turn").alias("turn"))
    return (
        ways.groupBy("x", "y")
        .agg(F.count("*").alias("n"), F.sum("turn").alias("turn"))
        .where("n <> 2 OR turn <> 0")
        .select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(True).alias("cut"))
    )


def _pieces(edges: DataFrame, piece: int, block: int) -> DataFrame:
    """Stretches of a ring's edges from one cut, ``start``, up to the next or to the end of their block.

    One shuffle by block serves the cuts and the stretches, and no window holds a long ring.
    """
    edges = edges.join(_junctions(edges), ["x1", "y1"], "left").withColumns(
        {
            "cut": F.coalesce("cut", F.lit(False)) | _chosen(F.col("x1"), F.col("y1"), piece),
            "block": F.floor(F.col("seq") / block),
        }
    )
    by = ("geom_id", "ring", "block")
    upto = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    started = edges.withColumn("start", F.max(F.when(F.col("cut"), F.col("seq"))).over(upto))
    return started.groupBy(*by, "start").agg(
        F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("doubled"),
        F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"),
        F.min(F.struct("x1", "y1", "seq")).alias("smallest"),
        F.collect_list(F.struct("seq", *COORDINATES)).alias("way"),
    )


def _block_facts(pieces: DataFrame, max_offset: float) -> DataFrame:
    """Per block the cut before it, and tolerance, first and last cut of its ring.

    A ring without a cut is cut at its smallest vertex. Moving a border by ``t`` changes the area by at
    most ``t`` times its length, so a tolerance of half the area by the length leaves each ring half of
    its area.
    """
    blocks = pieces.groupBy("geom_id", "ring", "block").agg(
        F.sum("doubled").alias("doubled"),
        F.sum("length").alias("length"),
        F.min("smallest").alias("smallest"),
        F.min("start").alias("first"),
        F.max("start").alias("last"),
    )
    ring = Window.partitionBy("geom_id", "ring")
    before = ring.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    area = F.abs(F.sum("doubled").over(ring)) / 2
    smallest = F.min("smallest").over(ring).getField("seq")
    return blocks.select(
        "geom_id",
        "ring",
        "block",
        F.max("last").over(before).alias("carried"),
        F.least(F.lit(float(max_offset)), area / F.sum("length").over(ring) / 2).alias("tolerance"),
        F.coalesce(F.max("last").over(ring), smallest).alias("last_cut"),
        F.coalesce(F.min("first").over(ring), smallest).alias("first_cut"),
    )


def _arcs(edges: DataFrame, max_offset: float, piece: int, block: int) -> DataFrame:
    """``geom_id, ring, tolerance, points, flipped, key`` of each stretch between two cuts of a ring.

    ``points`` are ``x, y, seq`` of vertices in the direction of the smaller end, the same for all rings.
    """
    pieces = _written(_pieces(edges, piece, block), "simplify-pieces")
    ring = ("geom_id", "ring")
    placed = lookup_join(pieces, _block_facts(pieces, max_offset), [*ring, "block"])
    # What comes before the first cut ends the arc that the last one starts.
    arcs = (
        placed.withColumn("arc", F.coalesce("start", "carried", "last_cut"))
        .groupBy(*ring, "arc")
        .agg(
            F.min("tolerance").alias("tolerance"),
            F.min("first_cut").alias("first_cut"),
            F.flatten(F.collect_list("way")).alias("way"),
        )
    )

    def in_order(edge: Column) -> Column:
        late = F.coalesce(edge["seq"] < F.col("first_cut"), F.lit(True))
        return F.struct(late.alias("late"), *[edge[name].alias(name) for name in ("seq", *COORDINATES)])

    arcs = arcs.withColumn("way", F.sort_array(F.transform("way", in_order)))

    def point(edge: Column, x: str, y: str, seq: Column) -> Column:
        return F.struct(edge[x].alias("x"), edge[y].alias("y"), seq.alias("seq"))

    last = F.element_at("way", -1)
    none = F.lit(None).cast(edges.schema["seq"].dataType)
    starts = F.transform("way", lambda edge: point(edge, "x1", "y1", edge["seq"]))
    arcs = arcs.withColumn("points", F.concat(starts, F.array(point(last, "x2", "y2", none))))

    def end(one: int, two: int) -> Column:
        places = [F.element_at("points", at) for at in (one, two)]
        return F.struct(*[place[name].alias(f"{name}{at}") for at, place in enumerate(places) for name in ("x", "y")])

    arcs = arcs.withColumns({"head": end(1, 2), "tail": end(-1, -2)})
    arcs = arcs.withColumn("flipped", F.col("tail") < F.col("head"))
    return arcs.select(
        *ring,
        "tolerance",
        F.when(F.col("flipped"), F.reverse("points")).otherwise(F.col("points")).alias("points"),
        "flipped",
        F.struct(F.when(F.col("flipped"), F.col("tail")).otherwise(F.col("head")).alias("end"), F.size("points").alias("n")).alias("key"),
    )


def kept_vertices(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Which vertices of several arcs stay; arc ``i`` has those from ``offsets[i]`` up to the next.

    All arcs are cut further at the same time, once per round, at the first of their farthest vertices.
    """
    kept = np.zeros(x.size, bool)
    kept[offsets[:-1]] = kept[offsets[1:] - 1] = True
    limit = np.repeat(tolerance * tolerance, np.diff(offsets))
    left = np.flatnonzero(~kept)
    while left.size:
        marks = np.flatnonzero(kept)
        part = np.searchsorted(marks, left)
        a, b = marks[part - 1], marks[part]
        dx, dy = x[b] - x[a], y[b] - y[a]
        along = (x[left] - x[a]) * dx + (y[left] - y[a]) * dy
        square = dx * dx + dy * dy
        share = np.clip(np.divide(along, square, out=np.zeros_like(along), where=square > 0), 0.0, 1.0)
        ex, ey = x[left] - (x[a] + share * dx), y[left] - (y[a] + share * dy)
        far = ex * ex + ey * ey
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(first, left.size))
        top = np.maximum.reduceat(far, first)
        split = top > limit[left[first]]
        at_top = np.flatnonzero((far == np.repeat(top, sizes)) & np.repeat(split, sizes))
        new = left[at_top[np.unique(part[at_top], return_index=True)[1]]]
        kept[new] = True
        left = left[np.repeat(split, sizes)]
        left = left[~kept[left]]
    return kept


def _simplified(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            offsets = points.offsets.to_numpy() - points.offsets[0].as_py()
            vertices = points.flatten()
            x, y = (vertices.field(vertices.type.get_field_index(name)).to_numpy() for name in ("x", "y"))
            seq = vertices.field(vertices.type.get_field_index("seq"))
            stay = np.flatnonzero(kept_vertices(x, y, offsets, batch.column("tolerance").to_numpy()))
            arc = np.searchsorted(offsets, stay, side="right") - 1
            pair = np.flatnonzero(arc[1:] == arc[:-1])
            flipped = batch.column("flipped").to_numpy(zero_copy_only=False)[arc[pair]]
            a = np.where(flipped, stay[pair + 1], stay[pair])
            b = np.where(flipped, stay[pair], stay[pair + 1])
            ids = [batch.column(name).take(pa.array(arc[pair])) for name in ("geom_id", "ring")]
            yield pa.RecordBatch.from_arrays(
                [*ids, seq.take(pa.array(a)), pa.array(x[a]), pa.array(y[a]), pa.array(x[b]), pa.array(y[b])], names
            )

    return run


def simplify_edges(
    edges: DataFrame, max_offset: float, geom_id: str = "geom_id", piece: int = PIECE, block: int = BLOCK
) -> DataFrame:
    """Edge table with simpler borders (G2): ``geom_id, ring, seq`` and coordinates.

    Every vertex left out lies within ``max_offset`` degrees of the new border. A border that several
    polygons share gets one shape in all of them. No ring vanishes: the tolerance of an arc is at most
    half the area by the length of each ring that has it, so a ring keeps half its area or more, and a
    ring without area only loses vertices on its lines. Arcs are simplified each for itself, so borders
    closer together than the offset may cross.

    A kept edge has the ``seq`` of the edge that started at its first vertex. Other columns are left
    out, as are edges without length or with a missing coordinate; a ring with a gap is cut there. Ids
    may be NULL. Arcs end where borders meet and at one of ``piece`` vertices besides, chosen by place,
    so that a row holds a few times ``piece`` vertices; windows hold ``block`` edges of a ring. Edges,
    pieces of arcs and arcs are written to the shared folder before the result is asked for.
    """
    own = edges.select(
        F.col(geom_id).alias("geom_id"),
        "ring",
        "seq",
        # Adding zero makes one zero of both.
        *[(F.col(name).cast("double") + F.lit(0.0)).alias(name) for name in COORDINATES],
    ).where("x1 <> x2 OR y1 <> y2")
    own = _written(own, "simplify-edges")
    arcs = _written(_arcs(own, max_offset, piece, block), "simplify-arcs")
    tolerances = arcs.groupBy("key").agg(F.min("tolerance").alias("tolerance"))
    arcs = lookup_join(arcs.drop("tolerance"), tolerances, ["key"]).drop("key")
    kinds = ", ".join(f"{name} {own.schema[name].dataType.simpleString()}" for name in own.columns)
    simple = arcs.mapInArrow(_simplified(own.columns), kinds)
    return simple.withColumnRenamed("geom_id", geom_id)
