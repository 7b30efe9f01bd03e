"""Checking SQL for the registered queries, written without the engine's operators.

Derived tables are inlined as common table expressions over the given tables.
"""

from __future__ import annotations

from embergrid import fixed_values as fixed
from embergrid.plans import inputs
from embergrid.operators.simplify import PIECE
from embergrid.plans.catalog import DISTRICT_OFFSET, INNER_BOUNDS

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
PAGE = inputs.EVENT_PAGE_SIZE


def _derived_sql(name: str) -> str:
    base, columns = inputs.COLUMNS[name]
    items = ", ".join(f"{expression} AS {column}" for column, expression in columns.items())
    return f"SELECT {items} FROM {base}"


def _edges_sql() -> tuple[str, str]:
    """SQL of the edge table and of the polygon corners it pairs up."""
    corners = ", ".join(
        f"({ring},{seq},{dx},{dy})"
        for ring, outline in enumerate((inputs.OUTER, inputs.HOLE))
        for seq, (dx, dy) in enumerate(outline)
    )
    return (
        f"SELECT a.geom_id, a.ring, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 "
        f"FROM p a JOIN p b ON a.geom_id = b.geom_id AND a.ring = b.ring AND b.seq = a.seq + 1"
    ), (
        f"SELECT geom_id, ring, seq, CAST(cx + k*dx AS DOUBLE)/1000 AS x, "
        f"CAST(cy + k*dy AS DOUBLE)/1000 AS y FROM fx_centres "
        f"CROSS JOIN (VALUES {corners}) AS v(ring, seq, dx, dy)"
    )


EDGES, CORNERS = _edges_sql()


def _with(select: str, *names: str, **extra: str) -> str:
    """``select`` over derived tables by name and extra tables by text."""
    parts = []
    for name in names:
        if name == "fx_edges":
            parts.append(f"fx_centres AS ({_derived_sql('fx_centres')})")
            parts.append(f"p AS ({CORNERS})")
            parts.append(f"fx_edges AS ({EDGES})")
        else:
            parts.append(f"{name} AS ({_derived_sql(name)})")
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {select}"


def _number(text: str) -> str:
    value = f"TRY_CAST({text} AS DOUBLE)"
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') AND isfinite({value}) THEN {value} END"


def _acres(number: str, suffix: str) -> str:
    decimals = f"regexp_replace(format('{{:,.2f}}', {number}), '0+$', '')"
    return f"regexp_replace({decimals}, '\\.$', '') || '{suffix}'"


def _snap(column: str, steps: int) -> str:
    return f"floor({column} * {steps}.0 + 0.5) / {steps}.0"


STATE_CAMERAS = (
    "SELECT cam_key, CAST(site_id AS STRING) AS id, "
    "coalesce(nullif(name, ''), nullif(source, ''), 'Camera') AS name, "
    "CAST(pan AS STRING) AS pan, image_url AS image, state, county, "
    f"{_number('longitude')} AS lon, {_number('latitude')} AS lat FROM fx_cameras "
    f"WHERE upper(state) = 'OR' AND ({_number('latitude')}) IS NOT NULL "
    f"AND ({_number('longitude')}) IS NOT NULL"
)
CAMERA_HEADING = (
    "cam_key, name AS title, "
    "nullif(concat_ws(', ', nullif(county, ''), nullif(state, '')), '') AS location"
)
IN_BOUNDS = "lon BETWEEN -124.7 AND -116.4 AND lat BETWEEN 41.9 AND 46.4"

# Error texts, bounds and state codes in this file are fixed values that results must show.
OUTCOMES = (
    "SELECT request_id, http_status, body, json_valid(body) AS is_json, "
    "CASE WHEN json_valid(body) THEN json_extract(body, '$.error') IS NOT NULL ELSE FALSE END "
    "AS has_error, "
    "CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.error.code') AS DOUBLE) END "
    "AS error_code, "
    "CASE WHEN json_valid(body) THEN json_extract_string(body, '$.error.message') END "
    "AS error_message, "
    "left(trim(regexp_replace(body, '\\s+', ' ', 'g')), 160) AS short FROM fx_landed"
)
TRIAGED = (
    "SELECT *, CASE WHEN NOT is_json THEN 'invalid_json' "
    "WHEN has_error OR http_status NOT BETWEEN 200 AND 299 THEN 'service_error' ELSE 'ok' END "
    "AS outcome FROM outcomes"
)
RATED = (
    "SELECT *, CASE outcome WHEN 'service_error' THEN coalesce(error_code, http_status) = 429 "
    "OR coalesce(error_code, http_status) >= 500 "
    "WHEN 'invalid_json' THEN http_status IN (400, 408, 429) OR http_status >= 500 END "
    "AS retryable, "
    "CASE outcome WHEN 'service_error' "
    "THEN coalesce(error_message, 'ArcGIS query HTTP ' || http_status) "
    "WHEN 'invalid_json' "
    "THEN 'ArcGIS returned invalid JSON (HTTP ' || http_status || '): ' || short END AS message "
    "FROM triaged"
)

RANKED_EVENTS = (
    "SELECT event_type AS layer, event_id, value, "
    "ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn FROM events"
)
PAGES = (
    f"SELECT layer, rn // {PAGE} AS page_no, MIN(rn) AS result_offset, COUNT(*) AS page_len, "
    f"COUNT(*) = {PAGE} AS exceeded FROM ranked GROUP BY layer, rn // {PAGE} "
    f"HAVING NOT (layer = 'error' AND rn // {PAGE} = 1) "
    f"AND NOT (layer = 'view' AND rn // {PAGE} = 2) UNION ALL "
    f"SELECT event_type, 999999, CASE event_type WHEN 'view' THEN {inputs.STUCK_AT} ELSE COUNT(*) "
    "END, 0, TRUE FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type"
)
STOPS = (
    "SELECT layer, MIN(result_offset) AS stop_at FROM pages_in "
    f"WHERE NOT exceeded AND page_len < {PAGE} GROUP BY layer"
)
ASKED = (
    "SELECT pages_in.* FROM pages_in LEFT JOIN stops USING (layer) "
    "WHERE stop_at IS NULL OR result_offset <= stop_at"
)
RUNNING = (
    "SELECT layer, page_no, result_offset, page_len, exceeded, "
    "coalesce(SUM(page_len) OVER (PARTITION BY layer ORDER BY page_no "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected, "
    "LEAD(page_no) OVER (PARTITION BY layer ORDER BY page_no) AS nxt FROM asked"
)

STATES = (
    "SELECT layer, CASE WHEN SUM(CASE WHEN exceeded AND page_len = 0 THEN 1 ELSE 0 END) > 0 "
    "THEN 'not_advanced' "
    "WHEN SUM(CASE WHEN expected <> result_offset THEN 1 ELSE 0 END) > 0 THEN 'gap' "
    f"WHEN SUM(CASE WHEN nxt IS NULL AND NOT exceeded AND page_len < {PAGE} "
    "THEN 1 ELSE 0 END) = 1 THEN 'complete' ELSE 'unfinished' END AS status, "
    "CAST(SUM(page_len) AS BIGINT) AS filled FROM w GROUP BY layer"
)
PAGE_STATES = (
    f"ranked AS ({RANKED_EVENTS}), pages_in AS ({PAGES}), stops AS ({STOPS}), "
    f"asked AS ({ASKED}), w AS ({RUNNING}), states AS ({STATES})"
)

HITS = (
    "SELECT objectid, geom_id FROM (SELECT f.objectid, e.geom_id, COUNT(*) AS n "
    "FROM fx_fires f JOIN fx_edges e ON (e.y1 > f.lat) <> (e.y2 > f.lat) "
    "AND f.lon < (e.x2 - e.x1) * (f.lat - e.y1) / (e.y2 - e.y1) + e.x1 "
    "WHERE e.y1 <> e.y2 GROUP BY 1, 2) WHERE n % 2 = 1"
)

def _count(*columns: str) -> str:
    """How many of the columns are not missing."""
    return " + ".join(f"CAST({column} IS NOT NULL AS INTEGER)" for column in columns)


FOCUS = "SELECT MIN(oid) AS oid FROM fx_boundary WHERE geom_type <> 'Point' AND (state_fips = '41' OR geoid = '41')"
FEATURES = (
    "SELECT 'cameras' AS layer, id AS feature_id, 'Point' AS geom_type, lon, lat, name, "
    f"{_count('id', 'name', 'pan', 'image', 'state', 'county')} AS n_properties, "
    "TRUE AS has_geometry FROM in_state UNION ALL "
    "SELECT 'fires', CAST(objectid AS STRING), 'Point', lon, lat, incident_name, "
    f"{_count('incident_name', 'incident_size', 'percent_contained', 'poo_county', 'poo_state', _number('incident_size'))}, "
    "TRUE FROM fx_fires UNION ALL "
    "SELECT 'perimeters', CAST(geom_id AS STRING), "
    "CASE WHEN geom_id % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END, NULL, NULL, "
    "attr_incident_name, "
    f"{_count('poly_incident_name', 'attr_incident_name', 'poly_gisacres', 'attr_percent_contained', 'attr_poo_county', 'attr_poo_state')}, "
    "TRUE FROM fx_perimeters UNION ALL "
    "SELECT 'burns', CAST(event_id AS STRING), geom_type, lon, lat, name, "
    f"{_count('name', 'start_ms', 'start_text', 'watchduty_url', 'acreage')}, TRUE "
    f"FROM fx_burns WHERE {IN_BOUNDS} UNION ALL "
    "SELECT 'boundary', CAST(b.oid AS STRING), geom_type, NULL, NULL, "
    "CASE WHEN b.oid = focus.oid THEN 'oregon' ELSE 'outside' END, "
    f"1 + {_count('state_fips', 'geoid')}, FALSE "
    "FROM fx_boundary b CROSS JOIN focus WHERE geom_type <> 'Point'"
)
_SIZE = "TRY_CAST(incident_size AS DOUBLE)"
_GIS_ACRES = "TRY_CAST(poly_gisacres AS DOUBLE)"
LOADED = (
    "SELECT 'cameras' AS layer, id AS feature_id, 'Point' AS geom_type, lon, lat, name, "
    "CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS acres, "
    f"{_count('id', 'name', 'pan', 'image', 'state', 'county')} AS n_properties, "
    "TRUE AS has_geometry FROM in_state UNION ALL "
    f"SELECT 'fires', CAST(objectid AS STRING), 'Point', lon, lat, incident_name, {_SIZE}, {_SIZE}, "
    f"{_count('incident_name', 'percent_contained', 'poo_county', 'poo_state', _SIZE, _SIZE)}, TRUE "
    f"FROM fx_fires WHERE poo_state = '{fixed.STATE_CODE}' UNION ALL "
    "SELECT 'perimeters', CAST(geom_id AS STRING), "
    "CASE WHEN geom_id % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END, NULL, NULL, "
    f"attr_incident_name, {_GIS_ACRES}, NULL, "
    f"{_count('poly_incident_name', 'attr_incident_name', 'poly_gisacres', 'attr_percent_contained', 'attr_poo_county', 'attr_poo_state')}, "
    f"TRUE FROM fx_perimeters WHERE attr_poo_state = '{fixed.STATE_CODE}' UNION ALL "
    "SELECT 'burns', CAST(event_id AS STRING), 'Point', lon, lat, name, acreage, NULL, "
    f"{_count('name', 'coalesce(CAST(start_ms AS STRING), start_text)', 'watchduty_url', 'acreage')}, TRUE "
    f"FROM fx_burns WHERE {IN_BOUNDS} AND geom_type <> 'Polygon' UNION ALL "
    "SELECT 'boundary', CAST(b.oid AS STRING), geom_type, NULL, NULL, "
    "CASE WHEN b.oid = focus.oid THEN 'oregon' ELSE 'outside' END, NULL, NULL, "
    f"1 + {_count('state_fips', 'geoid')}, TRUE FROM fx_boundary b CROSS JOIN focus "
    f"WHERE geom_type <> 'Point' AND state_fips IN {fixed.STATE_FIPS}"
)
LAYER_TABLES = ("fx_cameras", "fx_fires", "fx_perimeters", "fx_burns", "fx_boundary")

PERIMETER_CARDS = (
    "SELECT geom_id, coalesce(nullif(poly_incident_name, ''), nullif(attr_incident_name, ''), "
    f"'Fire') AS title, {_acres(_number('poly_gisacres'), ' acres')} AS acres_text, "
    "CAST(CAST(attr_percent_contained AS BIGINT) AS STRING) || '% contained' AS contained_text, "
    "nullif(concat_ws(', ', nullif(attr_poo_county, ''), "
    "regexp_replace(attr_poo_state, '^US-', '')), '') AS location FROM fx_perimeters"
)

# Vertices of a ring on the grid: the last of each run of equal neighbours starts an edge.
GRID_STEPS = 20
THIN_CORNERS = (
    f"SELECT geom_id, ring, seq, {_snap('x', GRID_STEPS)} AS x, {_snap('y', GRID_STEPS)} AS y "
    "FROM p"
)
THIN_NEXT = (
    "SELECT *, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny FROM thin_corners "
    "WINDOW w AS (PARTITION BY geom_id, ring ORDER BY seq)"
)
THIN_RUNS = "SELECT * FROM thin_next WHERE nx IS NULL OR nx <> x OR ny <> y"
THIN_EDGES = (
    "SELECT geom_id, ring, seq, x AS x1, y AS y1, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2, "
    "COUNT(*) OVER (PARTITION BY geom_id, ring) AS corners FROM thin_runs "
    "WINDOW w AS (PARTITION BY geom_id, ring ORDER BY seq)"
)

_WEST, _SOUTH, _EAST, _NORTH = INNER_BOUNDS


def _shaped_tables() -> dict[str, str]:
    """Corners on the perimeters' grid, one per run of equal neighbours, then rounded."""
    steps = round(1 / fixed.PERIMETER_MAX_OFFSET)
    return {
        "grid_corners": (
            f"SELECT geom_id, ring, seq, {_snap('x', steps)} AS x, {_snap('y', steps)} AS y FROM p"
        ),
        "grid_next": (
            "SELECT *, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny FROM grid_corners "
            "WINDOW w AS (PARTITION BY geom_id, ring ORDER BY seq)"
        ),
        "round_runs": (
            f"SELECT geom_id, ring, seq, {_snap('x', 1000)} AS x, {_snap('y', 1000)} AS y "
            "FROM grid_next WHERE nx IS NULL OR nx <> x OR ny <> y"
        ),
    }


def _thinned() -> str:
    return _with(
        "SELECT geom_id, ring, seq, x1, y1, x2, y2 FROM thin_edges "
        "WHERE x2 IS NOT NULL AND corners >= 4",
        "fx_edges",
        thin_corners=THIN_CORNERS,
        thin_next=THIN_NEXT,
        thin_runs=THIN_RUNS,
        thin_edges=THIN_EDGES,
    )


def _simplified() -> str:
    """Arcs between cuts, each cut further at its farthest vertex by recursion."""
    grid = ", ".join(f"{text} AS {name}" for name, text in inputs.DISTRICT_GRID.items())
    place = ", ".join(f"{text} AS {name}" for name, text in inputs.DISTRICT_PLACE.items())
    mixed = "xor(CAST(floor(x * 1000000.0) AS BIGINT) * 73856093, CAST(floor(y * 1000000.0) AS BIGINT) * 19349663)"
    share = "CASE WHEN q > 0 THEN least(greatest(((x - ax) * dx + (y - ay) * dy) / q, 0), 1) ELSE 0 END"
    return (
        f"WITH RECURSIVE fx_districts AS ({_derived_sql('fx_districts')}), "
        f"steps AS (SELECT geom_id, i, j, CAST(t AS BIGINT) AS t FROM fx_districts, range({inputs.DISTRICT_STEPS}) r(t)), "
        f"v AS (SELECT geom_id, t AS seq, {place} FROM (SELECT *, {grid} FROM steps)), "
        "ways AS (SELECT geom_id, seq, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, "
        "coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY geom_id ORDER BY seq)), "
        "met AS (SELECT x, y FROM (SELECT x, y, nx, ny FROM ways UNION SELECT nx, ny, x, y FROM ways) "
        "GROUP BY x, y HAVING count(*) <> 2), "
        f"cuts AS (SELECT ways.*, CASE WHEN met.x IS NOT NULL OR {mixed} % {PIECE} = 0 THEN seq END AS cut "
        "FROM (SELECT * FROM ways) ways LEFT JOIN met USING (x, y)), "
        "arcs AS (SELECT *, max(cut) OVER (PARTITION BY geom_id ORDER BY seq) AS start, "
        "max(cut) OVER (PARTITION BY geom_id) AS last FROM cuts), "
        "edged AS (SELECT geom_id, coalesce(start, last) AS arc, start IS NULL AS late, seq, x, y, nx, ny FROM arcs), "
        "points AS (SELECT geom_id, arc, late, seq, x, y FROM edged UNION ALL SELECT geom_id, arc, TRUE, 1000 + max(seq), "
        "arg_max(nx, (late, seq)), arg_max(ny, (late, seq)) FROM edged GROUP BY geom_id, arc), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY geom_id, arc ORDER BY late, seq) AS k, "
        "count(*) OVER (PARTITION BY geom_id, arc) AS n FROM points), "
        "ends AS (SELECT geom_id, arc, max(n) AS n, (max(x) FILTER (k = n), max(y) FILTER (k = n), "
        "max(x) FILTER (k = n - 1), max(y) FILTER (k = n - 1)) < (max(x) FILTER (k = 1), max(y) FILTER (k = 1), "
        "max(x) FILTER (k = 2), max(y) FILTER (k = 2)) AS flipped FROM ranked GROUP BY geom_id, arc), "
        "d AS (SELECT r.geom_id, r.arc, r.seq, r.x, r.y, flipped, r.n, CASE WHEN flipped THEN r.n + 1 - k ELSE k END AS pos "
        "FROM ranked r JOIN ends e ON r.geom_id = e.geom_id AND r.arc = e.arc), "
        "parts(geom_id, arc, low, high, mid) AS (SELECT geom_id, arc, CAST(0 AS BIGINT), CAST(0 AS BIGINT), n FROM ends "
        "UNION ALL SELECT geom_id, arc, low, high, "
        "CASE WHEN max(far) > CAST({offset} AS DOUBLE) * CAST({offset} AS DOUBLE) THEN arg_max(pos, (far, -pos)) END FROM ("
        "SELECT geom_id, arc, low, high, pos, ex * ex + ey * ey AS far FROM (SELECT *, x - (ax + s * dx) AS ex, y - (ay + s * dy) AS ey FROM ("
        f"SELECT *, {share} AS s FROM (SELECT *, dx * dx + dy * dy AS q FROM (SELECT h.geom_id, h.arc, low, high, "
        "d.pos, d.x, d.y, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM ("
        "SELECT geom_id, arc, CASE WHEN low = 0 THEN 1 ELSE low END AS low, mid AS high FROM parts WHERE mid IS NOT NULL "
        "UNION ALL SELECT geom_id, arc, mid, high FROM parts WHERE mid IS NOT NULL AND high > 0) h "
        "JOIN d a ON a.geom_id = h.geom_id AND a.arc = h.arc AND a.pos = h.low "
        "JOIN d b ON b.geom_id = h.geom_id AND b.arc = h.arc AND b.pos = h.high "
        "JOIN d ON d.geom_id = h.geom_id AND d.arc = h.arc AND d.pos > h.low AND d.pos < h.high))))) "
        "GROUP BY geom_id, arc, low, high), "
        "stay AS (SELECT DISTINCT geom_id, arc, mid AS pos FROM parts WHERE mid IS NOT NULL "
        "UNION SELECT geom_id, arc, 1 FROM ends), "
        "kept AS (SELECT d.*, CASE WHEN flipped THEN -d.pos ELSE d.pos END AS own FROM d JOIN stay s "
        "ON s.geom_id = d.geom_id AND s.arc = d.arc AND s.pos = d.pos) "
        "SELECT geom_id, CAST(0 AS INTEGER) AS ring, CAST(seq AS INTEGER) AS seq, x AS x1, y AS y1, x2, y2 FROM ("
        "SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM kept "
        "WINDOW w AS (PARTITION BY geom_id, arc ORDER BY own)) WHERE x2 IS NOT NULL"
    ).replace("{offset}", str(DISTRICT_OFFSET))


def _camera(select: str) -> str:
    return _with(select, "fx_cameras", in_state=STATE_CAMERAS)


def _flag(path: str) -> str:
    """Whether a part of the body is the boolean true."""
    return (
        f"(coalesce(json_type(body, '{path}') = 'BOOLEAN', FALSE) "
        f"AND coalesce(json_extract_string(body, '{path}') = 'true', FALSE))"
    )


def _landed(select: str) -> str:
    return _with(select, "fx_landed", outcomes=OUTCOMES, triaged=TRIAGED, rated=RATED)


ORACLE: dict[str, str] = {
    "cameras_in_state": _camera("SELECT * FROM in_state"),
    "camera_feed": _camera(
        "SELECT id, name, pan, image, state, county, lon, lat FROM in_state"
    ),
    "camera_feed_files": _camera(
        "SELECT id, name, pan, image, state, county, lon, lat FROM in_state"
    ),
    "camera_cards": _camera(
        f"SELECT {CAMERA_HEADING}, 'Pan: ' || coalesce(pan || '°', '—') AS pan_text, "
        "CASE WHEN starts_with(lower(image), 'https:') THEN image END AS image_url, "
        f"CASE WHEN id <> '0' THEN '{fixed.CAMERA_LINK_PREFIX}' || id END AS feed_url "
        "FROM in_state"
    ),
    "camera_previews": _camera(f"SELECT {CAMERA_HEADING} FROM in_state"),
    "feature_keys": _with(
        "SELECT cam_key, CAST(CASE WHEN pan IS NULL THEN cam_key ELSE site_id END AS STRING) "
        "AS feature_key FROM fx_cameras",
        "fx_cameras",
    ),
    "fires_acres": _with(
        f"SELECT objectid, {_number('incident_size')} AS acres, "
        f"coalesce({_number('incident_size')}, {_number('percent_contained')}) AS first_number "
        "FROM fx_fires",
        "fx_fires",
    ),
    "fire_classes": _with(
        "SELECT *, 'fire-marker-' || marker_size AS class_id FROM (SELECT objectid, acres, "
        "CAST(CASE WHEN acres >= 10000 THEN 28 WHEN acres >= 1000 THEN 24 "
        "WHEN acres >= 100 THEN 20 WHEN acres >= 10 THEN 18 WHEN acres >= 1 THEN 16 ELSE 14 END "
        "AS INTEGER) AS marker_size FROM sized)",
        "fx_fires",
        sized=f"SELECT objectid, {_number('incident_size')} AS acres FROM fx_fires",
    ),
    "fire_cards": _with(
        "SELECT 'point ' || objectid AS feature, coalesce(incident_name, 'Fire') AS title, "
        f"{_acres(_number('incident_size'), ' acres')} AS acres_text, "
        "CAST(CAST(percent_contained AS BIGINT) AS STRING) || '% contained' AS contained_text, "
        "nullif(concat_ws(', ', nullif(poo_county, ''), regexp_replace(poo_state, '^US-', '')), '')"
        " AS location FROM fx_fires UNION ALL "
        "SELECT 'perimeter ' || geom_id, title, acres_text, contained_text, location "
        "FROM perimeter_cards",
        "fx_fires",
        "fx_perimeters",
        perimeter_cards=PERIMETER_CARDS,
    ),
    "fires_in_state": _with(
        f"SELECT objectid, incident_name, poo_state, {_snap('lon', 100)} AS lon, "
        f"{_snap('lat', 100)} AS lat FROM fx_fires WHERE poo_state = 'US-OR'",
        "fx_fires",
    ),
    "burns_in_bounds": _with(
        "SELECT event_id, geom_type, lon, lat FROM fx_burns "
        f"WHERE geom_type IN ('Point', 'MultiPoint') AND {IN_BOUNDS}",
        "fx_burns",
    ),
    "burn_cards": _with(
        "SELECT event_id, coalesce(nullif(name, ''), 'Prescribed fire') AS title, "
        f"{_acres('acreage', ' target acres')} AS acres_text, "
        "'Scheduled: ' || coalesce(strftime(make_timestamp(start_ms * 1000), '%b %-d, %Y'), "
        "CASE WHEN start_text IS NOT NULL THEN 'Nov 14, 2023' END) "
        "AS schedule_text, "
        "CASE WHEN starts_with(watchduty_url, 'https:') THEN watchduty_url END AS link_url "
        "FROM fx_burns",
        "fx_burns",
    ),
    "boundary_kinds": _with(
        "SELECT oid, geom_type, CASE WHEN place = 1 AND hit THEN 'oregon' ELSE 'outside' END "
        "AS kind, CAST(CASE WHEN place = 1 AND hit THEN 1 ELSE 0 END AS INTEGER) AS draw_order "
        "FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY hit DESC, oid) AS place FROM matched)",
        "fx_boundary",
        matched=(
            "SELECT oid, geom_type, coalesce(state_fips = '41', FALSE) "
            "OR coalesce(geoid = '41', FALSE) AS hit FROM fx_boundary "
            "WHERE geom_type IN ('Polygon', 'MultiPolygon')"
        ),
    ),
    "boundary_outside": _with(
        "SELECT oid, 'outside' AS kind FROM matched "
        "WHERE oid <> (SELECT MIN(oid) FROM matched WHERE hit)",
        "fx_boundary",
        matched=(
            "SELECT oid, coalesce(state_fips = '41', FALSE) "
            "OR coalesce(geoid = '41', FALSE) AS hit FROM fx_boundary "
            "WHERE geom_type IN ('Polygon', 'MultiPolygon')"
        ),
    ),
    "boundary_in_list": _with(
        "SELECT oid, state_fips FROM fx_boundary WHERE state_fips IN "
        "('04', '06', '08', '16', '30', '32', '41', '49', '53', '56')",
        "fx_boundary",
    ),
    "landed_outcome": _landed(
        "SELECT request_id, outcome, error_code, retryable, message, "
        "CASE WHEN outcome = 'invalid_json' THEN short END AS preview FROM rated"
    ),
    "page_flags": _landed(
        "SELECT request_id, CAST(json_array_length(body, '$.features') AS BIGINT) AS page_len, "
        "CASE WHEN coalesce(json_type(body, '$.exceededTransferLimit'), 'NULL') = 'NULL' "
        f"THEN {_flag('$.properties.exceededTransferLimit')} "
        f"ELSE {_flag('$.exceededTransferLimit')} END AS exceeded "
        "FROM rated WHERE outcome = 'ok'"
    ),
    "pages_to_refetch": _landed(
        "SELECT 'landed' AS layer, request_id AS result_offset, http_status, outcome, message "
        "FROM rated WHERE retryable"
    ),
    "page_completeness": (
        f"WITH {PAGE_STATES} SELECT layer, status, (SELECT COUNT(*) FROM pages_in p "
        "WHERE p.layer = states.layer) AS pages FROM states"
    ),
    # The landed pages lack the stray empty end that the page table has for one layer.
    "page_completeness_recorded": (
        f"WITH {PAGE_STATES} SELECT layer, status, (SELECT COUNT(*) FROM pages_in p WHERE p.layer = "
        "states.layer AND (p.page_len > 0 OR states.layer <> 'click')) AS pages FROM states"
    ),
    # The landed pages lack the stray end of the page table.
    "load_status": (
        f"WITH {PAGE_STATES} SELECT layer, status = 'complete' AS ok, CASE status "
        f"WHEN 'not_advanced' THEN '{fixed.NOT_ADVANCED_ERROR}' WHEN 'complete' THEN NULL "
        "ELSE 'pages: ' || status END AS error, "
        "CASE WHEN status = 'complete' THEN filled ELSE 0 END AS rows FROM states"
    ),
    "paged_features": (
        f"WITH ranked AS ({RANKED_EVENTS}) SELECT layer, rn // {PAGE} * {PAGE} AS result_offset, "
        f"CAST(rn % {PAGE} AS INTEGER) AS pos, CAST(event_id AS STRING) AS feature_id, value "
        "FROM ranked"
    ),
    "page_slice": (
        "SELECT event_id, event_type, value FROM events ORDER BY event_id "
        f"LIMIT {fixed.PAGE_SIZE} OFFSET {fixed.PAGE_SIZE // 2}"
    ),
    "page_slice_by_text": (
        "SELECT p_name || ' ' || p_partkey AS name, p_partkey FROM part ORDER BY name LIMIT 600 OFFSET 750"
    ),
    "edges_page": _with(
        "SELECT * FROM fx_edges WHERE geom_id IN "
        "(SELECT DISTINCT geom_id FROM fx_edges ORDER BY geom_id LIMIT 50 OFFSET 20)",
        "fx_edges",
    ),
    "page_numbers": (
        "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS rank, "
        f"(ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) // {fixed.PAGE_SIZE} AS page_no FROM orders"
    ),
    "layer_versions": _with(
        "SELECT layer, CAST(seq AS BIGINT) AS seq, ok, error, rows FROM ("
        f"SELECT 'fires' AS layer, 2 AS seq, true AS ok, NULL AS error, (SELECT count(*) FROM fx_fires "
        f"WHERE poo_state = '{fixed.STATE_CODE}') AS rows "
        "UNION ALL SELECT 'burns', 2, false, 'pages: unfinished', 0 "
        "UNION ALL SELECT 'cameras', 1, true, NULL, (SELECT count(*) FROM in_state))",
        *LAYER_TABLES,
        in_state=STATE_CAMERAS,
        focus=FOCUS,
    ),
    "features_union": _with(FEATURES, *LAYER_TABLES, in_state=STATE_CAMERAS, focus=FOCUS),
    "layers_loaded": _with(LOADED, *LAYER_TABLES, in_state=STATE_CAMERAS, focus=FOCUS),
    "visible_features": _with(
        "SELECT layer, feature_id FROM all_features "
        "WHERE layer IN ('cameras', 'burns', 'boundary')",
        *LAYER_TABLES,
        in_state=STATE_CAMERAS,
        focus=FOCUS,
        all_features=FEATURES,
    ),
    "visible_features_by_groups": _with(
        "SELECT layer, feature_id, geom_type FROM all_features "
        "WHERE layer IN ('fires', 'cameras', 'boundary')",
        *LAYER_TABLES,
        in_state=STATE_CAMERAS,
        focus=FOCUS,
        all_features=FEATURES,
    ),
    "feature_lines": _with(
        "SELECT 'fires' AS layer, '{\"type\":\"Feature\",\"id\":\"' || objectid || "
        "'\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || lon || ',' || lat || "
        "']},\"properties\":{\"poo_state\":\"' || poo_state || '\"' || "
        "coalesce(',\"acres\":' || acres, '') || '}}' AS value "
        f"FROM (SELECT *, {_number('incident_size')} AS acres FROM fx_fires) UNION ALL "
        "SELECT 'perimeters', '{\"type\":\"Feature\",\"id\":\"' || geom_id || "
        "'\",\"geometry\":{\"type\":\"' || CASE WHEN geom_id % 3 = 0 THEN 'MultiPolygon' ELSE "
        "'Polygon' END || '\",\"coordinates\":' || CASE WHEN geom_id % 3 = 0 THEN '[' || rings || ']' "
        "ELSE rings END || '},\"properties\":{' || "
        "coalesce('\"attr_poo_state\":\"' || attr_poo_state || '\"', '') || '}}' "
        "FROM fx_perimeters JOIN ring_lists USING (geom_id)",
        "fx_fires",
        "fx_perimeters",
        "fx_edges",
        **_shaped_tables(),
        ring_texts=(
            "SELECT geom_id, ring, '[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY seq) "
            "|| ']' AS text FROM round_runs GROUP BY geom_id, ring HAVING COUNT(*) >= 4"
        ),
        ring_lists=(
            "SELECT geom_id, '[' || string_agg(text, ',' ORDER BY ring) || ']' AS rings "
            "FROM ring_texts GROUP BY geom_id"
        ),
    ),
    "perimeters_in_envelope": _with(
        # Clipping: the part of each edge, as a range of its length, that lies between both sides.
        f"SELECT geom_id FROM (SELECT geom_id, bool_or(low <= high) AS meets, "
        f"count(*) FILTER ((y1 > {_SOUTH}) <> (y2 > {_SOUTH}) "
        f"AND {_WEST} < (x2 - x1) * ({_SOUTH} - y1) / (y2 - y1) + x1) AS crossings FROM ("
        "SELECT *, greatest(0, CASE WHEN dx = 0 THEN (CASE WHEN x1 BETWEEN "
        f"{_WEST} AND {_EAST} THEN 0 ELSE 2 END) ELSE least(({_WEST} - x1) / dx, ({_EAST} - x1) / dx) END, "
        f"CASE WHEN dy = 0 THEN (CASE WHEN y1 BETWEEN {_SOUTH} AND {_NORTH} THEN 0 ELSE 2 END) "
        f"ELSE least(({_SOUTH} - y1) / dy, ({_NORTH} - y1) / dy) END) AS low, "
        f"least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest(({_WEST} - x1) / dx, ({_EAST} - x1) / dx) END, "
        f"CASE WHEN dy = 0 THEN 1 ELSE greatest(({_SOUTH} - y1) / dy, ({_NORTH} - y1) / dy) END) AS high "
        "FROM (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM fx_edges)) GROUP BY geom_id) "
        "WHERE meets OR crossings % 2 = 1",
        "fx_edges",
    ),
    "perimeters_shaped": _with(
        "SELECT geom_id, x AS x1, y AS y1, nx AS x2, ny AS y2 FROM (SELECT *, LEAD(x) OVER w AS nx, "
        "LEAD(y) OVER w AS ny, COUNT(*) OVER (PARTITION BY geom_id, ring) AS corners FROM "
        "(SELECT geom_id, ring, seq, x, y FROM round_runs) "
        "WINDOW w AS (PARTITION BY geom_id, ring ORDER BY seq)) "
        "WHERE nx IS NOT NULL AND corners >= 4",
        "fx_edges",
        **_shaped_tables(),
    ),
    "districts_simplified": _simplified(),
    "feed_shapes": _with(
        "SELECT feed, ok, CASE WHEN NOT ok THEN "
        f"'{fixed.CAMERA_PAYLOAD_ERROR}' END AS error FROM (SELECT feed, CASE WHEN payload IS NULL "
        "OR NOT json_valid(payload) THEN FALSE ELSE json_type(payload) = 'ARRAY' END AS ok "
        "FROM fx_payloads)",
        "fx_payloads",
    ),
    "page_numbers_by_group": (
        "SELECT grp, id, rank, rank // 100 AS page_no FROM (SELECT grp, id, ROW_NUMBER() OVER "
        "(PARTITION BY grp ORDER BY id NULLS FIRST) - 1 AS rank FROM (SELECT "
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 5 END AS grp, "
        "CASE WHEN o_orderkey = 7 THEN NULL ELSE o_orderkey END AS id FROM orders))"
    ),
    "boundary_kinds_by_set": (
        "SELECT set_id, oid, CASE WHEN oid = focus THEN 'oregon' ELSE 'outside' END AS kind, "
        "CAST(oid = focus AS INTEGER) AS draw_order FROM (SELECT set_id, oid, MIN(CASE WHEN hit "
        "THEN oid END) OVER (PARTITION BY set_id) AS focus FROM (SELECT CASE s_nationkey % 4 "
        "WHEN 0 THEN NULL ELSE s_nationkey % 4 END AS set_id, s_suppkey AS oid, "
        "s_suppkey % 3 = 1 AS hit FROM supplier))"
    ),
    "feature_query_page": _with(
        f"SELECT objectid, poo_state, {_snap('lon', 100)} AS lon, {_snap('lat', 100)} AS lat FROM "
        "(SELECT * FROM fx_fires WHERE poo_state = 'US-OR' ORDER BY objectid "
        "LIMIT 3000 OFFSET 4000)",
        "fx_fires",
    ),
    "edges_in_bounds": _with(
        f"SELECT geom_id, ring, seq, {_snap('x1', 1000)} AS x1, {_snap('y1', 1000)} AS y1, "
        f"{_snap('x2', 1000)} AS x2, {_snap('y2', 1000)} AS y2 FROM fx_edges WHERE geom_id IN "
        "(SELECT geom_id FROM p GROUP BY geom_id "
        f"HAVING MAX(x) >= {_WEST} AND MIN(x) <= {_EAST} AND MAX(y) >= {_SOUTH} AND MIN(y) <= {_NORTH})",
        "fx_edges",
    ),
    "geojson_edges": _with("SELECT * FROM fx_edges", "fx_edges"),
    "edges_rounded": _with(
        f"SELECT geom_id, ring, seq, {_snap('x1', 100)} AS x1, {_snap('y1', 100)} AS y1, "
        f"{_snap('x2', 100)} AS x2, {_snap('y2', 100)} AS y2 FROM fx_edges",
        "fx_edges",
    ),
    "edges_thinned": _thinned(),
    "perimeter_bbox_overlap": _with(
        "SELECT * FROM (SELECT geom_id, MIN(x) AS xmin, MIN(y) AS ymin, MAX(x) AS xmax, "
        f"MAX(y) AS ymax FROM p GROUP BY geom_id) WHERE xmax >= {_WEST} AND xmin <= {_EAST} "
        f"AND ymax >= {_SOUTH} AND ymin <= {_NORTH}",
        "fx_edges",
    ),
    "fires_in_perimeters": _with(HITS, "fx_fires", "fx_edges"),
    "top_perimeter_by_order": _with(
        "SELECT objectid, geom_id FROM (SELECT objectid, geom_id, ROW_NUMBER() OVER (PARTITION BY objectid ORDER BY "
        "CASE WHEN geom_id % 5 <> 0 THEN geom_id % 7 END DESC NULLS LAST, geom_id) AS place FROM hits) WHERE place = 1",
        "fx_fires",
        "fx_edges",
        hits=HITS,
    ),
    "top_perimeter_per_fire": _with(
        "SELECT objectid, MIN(geom_id) AS geom_id FROM hits GROUP BY objectid",
        "fx_fires",
        "fx_edges",
        hits=HITS,
    ),
    "fires_clipped": _with(
        "SELECT objectid, lon, lat FROM fx_fires f "
        "WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.objectid = f.objectid)",
        "fx_fires",
        "fx_edges",
        hits=HITS,
    ),
    "perimeter_hit_cards": _with(
        "SELECT objectid, c.* FROM (SELECT objectid, MIN(geom_id) AS geom_id FROM hits "
        "GROUP BY objectid) t JOIN perimeter_cards c ON c.geom_id = t.geom_id",
        "fx_fires",
        "fx_edges",
        "fx_perimeters",
        hits=HITS,
        perimeter_cards=PERIMETER_CARDS,
    ),
}

ORACLE |= {
    "sites_in_perimeters": _with(
        "SELECT DISTINCT site, geom_id FROM hits JOIN (SELECT o_orderkey, "
        f"{inputs.SITES['site']} AS site FROM orders) ON o_orderkey = objectid",
        "fx_fires",
        "fx_edges",
        hits=HITS,
    ),
    "sites_clipped": _with(
        f"SELECT {inputs.SITES['site']} AS site, lon, lat FROM fx_fires JOIN orders "
        "ON o_orderkey = objectid WHERE objectid NOT IN (SELECT objectid FROM hits)",
        "fx_fires",
        "fx_edges",
        hits=HITS,
    ),
}
ORACLE |= {
    f"{name}_shuffled": ORACLE[name]
    for name in (
        "fires_in_perimeters",
        "fires_clipped",
        "perimeter_hit_cards",
        "sites_in_perimeters",
        "sites_clipped",
    )
}
