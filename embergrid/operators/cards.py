"""Detail cards: display-ready text columns per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.functions.dates import date_text
from embergrid.functions.links import https_url, id_link
from embergrid.functions.numbers import finite_number, number_text, plain_text
from embergrid.functions.once import with_once
from embergrid.functions.text import first_text, joined_text, state_code


def camera_previews(cameras: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Title and location of each camera."""
    return cameras.select(*keep, *_camera_heading())


def camera_cards(cameras: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Title, location, pan, image and feed link of each camera."""
    numbers = with_once(cameras, _pan=finite_number(F.col("pan").cast("string")))
    texts = with_once(numbers, _pan=F.concat(plain_text(F.col("_pan")), F.lit(fixed.DEGREE)))
    pan_text = F.coalesce(F.col("_pan"), F.lit(fixed.NO_VALUE))
    return texts.select(
        *keep,
        *_camera_heading(),
        F.concat(F.lit("Pan: "), pan_text).alias("pan_text"),
        https_url(F.col("image")).alias("image_url"),
        id_link(fixed.CAMERA_LINK_PREFIX, F.col("id")).alias("feed_url"),
    )


def _camera_heading() -> tuple[Column, Column]:
    return (
        first_text(F.col("name"), F.lit(fixed.CAMERA_TITLE)).alias("title"),
        joined_text(F.col("county"), F.col("state")).alias("location"),
    )


def fire_union(points: DataFrame, perimeters: DataFrame) -> DataFrame:
    """Fire points and perimeters in one table; each side lacks some of the other's fields."""
    return points.unionByName(perimeters, allowMissingColumns=True)


def fire_cards(fires: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One card shape for points and perimeters.

    Title, county and state take the first non-empty alias, numbers the first alias present.
    Aliases the table lacks are skipped.
    """
    present = set(fires.columns)

    def aliases(*names: str) -> list[Column]:
        return [F.col(name) for name in names if name in present] or [F.lit(None).cast("string")]

    reported = finite_number(F.coalesce(*aliases("incident_size", "poly_gisacres")))
    acres = F.coalesce(F.col("acres"), reported) if "acres" in present else reported
    contained = finite_number(F.coalesce(*aliases("percent_contained", "attr_percent_contained")))
    title = first_text(
        *aliases("incident_name", "poly_incident_name", "attr_incident_name"),
        F.lit(fixed.FIRE_TITLE),
    )
    return fires.select(
        *keep,
        title.alias("title"),
        F.concat(number_text(acres, 2), F.lit(" acres")).alias("acres_text"),
        F.concat(number_text(contained, 0), F.lit("% contained")).alias("contained_text"),
        joined_text(
            first_text(*aliases("poo_county", "attr_poo_county")),
            state_code(first_text(*aliases("poo_state", "attr_poo_state"))),
        ).alias("location"),
    )


def burn_cards(burns: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Title, target acres, schedule and link of each planned burn."""
    acres = number_text(finite_number(F.col("acreage").cast("string")), 2)
    day = date_text(F.col("start_ms"), F.col("start_text"))
    return burns.select(
        *keep,
        first_text(F.col("name"), F.lit(fixed.BURN_TITLE)).alias("title"),
        F.concat(acres, F.lit(" target acres")).alias("acres_text"),
        F.concat(F.lit("Scheduled: "), day).alias("schedule_text"),
        https_url(F.col("watchduty_url")).alias("link_url"),
    )
