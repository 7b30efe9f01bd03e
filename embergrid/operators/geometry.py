"""Polygon geometry as an edge table: one row per ring segment.

An edge table makes precision, thinning, boxes and containment relational, whatever the size of a
polygon. Nothing here needs a window over a ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid.functions.numbers import finite_number

COORDINATES = ("x1", "y1", "x2", "y2")


def rings_from_geojson(geometry: Column) -> Column:
    """Rings of a Polygon or of all parts of a MultiPolygon, as arrays of ``[x, y]``.

    ``geometry`` is a VARIANT; other types give NULL. Positions may hold quoted numbers.
    """
    kind = F.try_variant_get(geometry, "$.type", "string")
    ring_list = "array<array<array<string>>>"
    text = F.when(
        kind == "Polygon", F.try_variant_get(geometry, "$.coordinates", ring_list)
    ).when(
        kind == "MultiPolygon",
        F.flatten(F.try_variant_get(geometry, "$.coordinates", f"array<{ring_list}>")),
    )
    return F.transform(
        text, lambda ring: F.transform(ring, lambda at: F.transform(at, finite_number))
    )


def polygon_edges(
    polygons: DataFrame, geom_id: str = "geom_id", rings: str = "rings", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Edge table of polygons given as arrays of rings (G3); narrow, no shuffle.

    ``ring`` counts over all parts, ``seq`` within a ring. Edges with a missing coordinate are
    left out.
    """
    ring_rows = polygons.select(geom_id, *keep, F.posexplode(rings).alias("ring", "pts"))
    pairs = F.arrays_zip(
        F.slice("pts", F.lit(1), F.greatest(F.size("pts") - 1, F.lit(0))).alias("a"),
        F.slice("pts", F.lit(2), F.greatest(F.size("pts") - 1, F.lit(0))).alias("b"),
    )
    edges = ring_rows.select(
        geom_id, *keep, "ring", F.posexplode(pairs).alias("seq", "pair")
    ).select(
        geom_id,
        *keep,
        "ring",
        "seq",
        F.get("pair.a", 0).alias("x1"),
        F.get("pair.a", 1).alias("y1"),
        F.get("pair.b", 0).alias("x2"),
        F.get("pair.b", 1).alias("y2"),
    )
    return edges.dropna(subset=list(COORDINATES))


def snapped(number: Column, steps: float) -> Column:
    """Nearest multiple of ``1/steps``; ties go up."""
    return F.floor(number * F.lit(float(steps)) + F.lit(0.5)) / F.lit(float(steps))


def round_edges(edges: DataFrame, decimals: int) -> DataFrame:
    """Coordinates at a number of decimals (G1)."""
    return edges.withColumns({name: snapped(F.col(name), 10**decimals) for name in COORDINATES})


def round_points(points: DataFrame, decimals: int) -> DataFrame:
    """Point coordinates at a number of decimals (G1)."""
    return points.withColumns(
        {name: snapped(F.col(name), 10**decimals) for name in ("lon", "lat")}
    )


def thin_edges(edges: DataFrame, max_offset: float, geom_id: str = "geom_id") -> DataFrame:
    """Drops vertices that fall together on a grid of ``max_offset`` degrees.

    Snapped to the grid, an edge whose ends meet is dropped and its neighbours still join up. Each
    kept edge keeps the ``seq`` of the last vertex of its run. Rings left with fewer than three
    edges enclose nothing and go too: such a ring has at most two edges, so its lowest and highest
    ``seq`` name them all and the anti-join key is unique per edge, even if one ring holds most
    rows.
    """
    steps = round(1 / max_offset, 9)
    kept = edges.withColumns({name: snapped(F.col(name), steps) for name in COORDINATES}).where(
        "x1 <> x2 OR y1 <> y2"
    )
    collapsed = (
        kept.groupBy(geom_id, "ring")
        .agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
        .where("n < 3")
        .select(geom_id, "ring", F.explode(F.array_distinct(F.array("low", "high"))).alias("seq"))
    )
    return kept.join(collapsed, [geom_id, "ring", "seq"], "left_anti")


def shaped_rings(rings: Column, decimals: int, max_offset: float) -> Column:
    """Rings of one polygon thinned, then rounded, by the rules of ``thin_edges`` and ``round_edges``.

    ``rings`` are arrays of ``[x, y]`` as text. Positions without two finite numbers are left out. An
    outer ring, the first, that the grid leaves with fewer than three edges is rounded only, and if
    that is too coarse too it stays as it is: a polygon never vanishes for being small, and all its
    vertices are within the offset. Holes that enclose nothing on the grid go.
    """
    steps, scale = round(1 / max_offset, 9), 10**decimals

    def moved(ring: Column, *grids: float) -> Column:
        def place(at: Column, index: int) -> Column:
            number = finite_number(F.get(at, F.lit(index)))
            # Only the first grid decides which vertices fall together.
            return snapped(number, grids[0]) if grids else number

        placed = F.transform(ring, lambda at: F.struct(place(at, 0).alias("x"), place(at, 1).alias("y")))
        whole = F.filter(placed, lambda at: at["x"].isNotNull() & at["y"].isNotNull())
        # Of neighbours on one spot one stays.
        following = F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0)))
        pairs = F.arrays_zip(whole.alias("at"), following.alias("then"))
        kept = F.filter(pairs, lambda pair: pair["then"].isNull() | (pair["at"] != pair["then"]))

        def position(pair: Column) -> Column:
            numbers = [pair["at"][name] for name in ("x", "y")]
            return F.array(*[snapped(number, grids[1]) if len(grids) > 1 else number for number in numbers])

        return F.transform(kept, position)

    def shaped(ring: Column, index: Column) -> Column:
        thinned = moved(ring, steps, scale)
        small = F.when(F.size(moved(ring, scale)) >= 4, moved(ring, scale)).otherwise(moved(ring))
        return F.when((index > 0) | (F.size(thinned) >= 4), thinned).otherwise(small)

    return F.filter(F.transform(rings, shaped), lambda ring: F.size(ring) >= 4)


def edge_boxes(edges: DataFrame, geom_id: str = "geom_id") -> DataFrame:
    """Bounding box per polygon, combined before the shuffle."""
    return edges.groupBy(geom_id).agg(
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
    )


def boxes_overlapping(boxes: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Boxes that meet west, south, east, north, touching included."""
    west, south, east, north = bounds
    return boxes.where(
        (F.col("xmax") >= west)
        & (F.col("xmin") <= east)
        & (F.col("ymax") >= south)
        & (F.col("ymin") <= north)
    )


def polygons_in_envelope(
    edges: DataFrame, bounds: tuple[float, float, float, float], geom_id: str = "geom_id"
) -> DataFrame:
    """Polygons whose area meets west, south, east, north, touching included.

    That is so if an edge meets the envelope, or if none does and the envelope lies in the polygon,
    which one of its corners tells. An edge meets it unless it is all on one side, or all corners are
    on one side of the edge's line. One aggregation over the edges, with map-side combine; holes and
    parts need nothing extra.
    """
    west, south, east, north = (F.lit(float(value)) for value in bounds)
    x1, y1, x2, y2 = (F.col(name) for name in COORDINATES)
    beside = (
        (F.greatest(x1, x2) < west)
        | (F.least(x1, x2) > east)
        | (F.greatest(y1, y2) < south)
        | (F.least(y1, y2) > north)
    )
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (west, east) for y in (south, north)]
    meets = ~beside & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    # The ray from the south-west corner towards larger x.
    crosses = ((y1 > south) != (y2 > south)) & (west < (x2 - x1) * (south - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    return (
        edges.groupBy(geom_id)
        .agg(F.bool_or(meets).alias("meets"), F.count_if(crosses).alias("crossings"))
        .where("meets OR crossings % 2 = 1")
        .select(geom_id)
    )
