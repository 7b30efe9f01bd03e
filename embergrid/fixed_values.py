"""These must stay as they are for the results to be right."""

from __future__ import annotations

# Camera feed
CAMERA_STATE = "OR"
CAMERA_TITLE = "Camera"
CAMERA_LINK_PREFIX = "https://alertwest.live/cam-console/"
CAMERA_PAYLOAD_ERROR = "Camera API returned an unexpected payload"

# Attribute filters and field lists of the paged layers
STATE_CODE = "US-OR"
FIRE_FIELDS = (
    "IncidentName",
    "IncidentSize",
    "PercentContained",
    "POOCounty",
    "POOState",
    "IncidentTypeCategory",
)
PERIMETER_FIELDS = (
    "poly_IncidentName",
    "attr_IncidentName",
    "poly_GISAcres",
    "attr_PercentContained",
    "attr_POOCounty",
    "attr_POOState",
    "attr_IncidentTypeCategory",
)
BURN_FIELDS = ("name", "prescribed_date_start", "watchduty_url", "acreage")
BOUNDARY_FIELDS = ("STATE", "GEOID")

# Bounds box in degrees: west, south, east, north
DATA_BOUNDS = (-124.7, 41.9, -116.4, 46.4)

# Boundary set
STATE_FIPS = ("04", "06", "08", "16", "30", "32", "41", "49", "53", "56")
FOCUS_FIPS = "41"
FOCUS_KIND = "oregon"
OUTSIDE_KIND = "outside"
BOUNDARY_MISSING_ERROR = "Oregon boundary geometry is missing"

# Minimum acres and marker size
FIRE_CLASS_PREFIX = "fire-marker"
FIRE_BREAKS = ((0, 14), (1, 16), (10, 18), (100, 20), (1000, 24), (10000, 28))

# Paging and geometry payload
PAGE_SIZE = 2000
PERIMETER_PAGE_SIZE = 25
PERIMETER_PRECISION = 3
PERIMETER_MAX_OFFSET = 0.01
BOUNDARY_PRECISION = 5
BOUNDARY_MAX_OFFSET = 0.002
PREVIEW_LENGTH = 160
QUERY_ERROR_PREFIX = "ArcGIS query HTTP "
NOT_ADVANCED_ERROR = "ArcGIS pagination did not advance"
INVALID_JSON_PREFIX = "ArcGIS returned invalid JSON (HTTP "

# Card texts
FIRE_TITLE = "Fire"
BURN_TITLE = "Prescribed fire"
NO_VALUE = "—"
DEGREE = "°"

# Layers of each group, and whether the group is on at the start
LAYER_GROUPS = (
    ("cameras", True, ("cameras",)),
    ("fires", False, ("fires", "perimeters_fill", "perimeters_line")),
    ("prescribed", False, ("burns",)),
)

# Layers drawn from another layer's table
LAYER_SOURCES = {"perimeters_fill": "perimeters", "perimeters_line": "perimeters"}
