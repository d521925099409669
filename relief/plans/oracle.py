"""Independent DuckDB SQL for every registered query.

Written against the driver's tables only.  The rasters are re-derived here in
plain SQL; the operators are re-stated in the most direct (often brute-force)
SQL form rather than mirroring the Spark plan, so the check is independent.
HALF_UP ratios use integer arithmetic ``(n*20000 + t) // (2*t) / 10000``.
"""

from __future__ import annotations

from relief.sources.fixtures import U_SHAPE

ROWS = "(SELECT max(o_orderkey) // 128 + 1 FROM orders)"

DEM = """dem AS (
  SELECT o_orderkey % 128 AS gx, o_orderkey // 128 AS gy,
         CAST(CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE floor(o_totalprice / 1000) END AS DOUBLE) AS value
  FROM orders)"""

DSM = """dsm AS (
  SELECT o_orderkey % 128 AS gx, o_orderkey // 128 AS gy,
         CAST(floor(o_totalprice / 1000) + coalesce(q, 0) AS DOUBLE) AS value
  FROM orders LEFT JOIN (SELECT l_orderkey, floor(sum(l_quantity) / 10) AS q FROM lineitem GROUP BY l_orderkey) l
       ON l.l_orderkey = orders.o_orderkey)"""

HAND_EXTENT = """hand_extent AS (
  SELECT o_orderkey % 128 AS gx, o_orderkey // 128 AS gy,
         CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 0e0 WHEN o_custkey % 13 = 0 THEN -1e0
              ELSE CAST(floor(o_totalprice / 25000) AS DOUBLE) END AS value
  FROM orders)"""

HAND_DEPTH = """hand_depth AS (
  SELECT o_orderkey % 128 AS gx, o_orderkey // 128 AS gy, CAST(floor(o_totalprice / 50000) AS DOUBLE) AS value
  FROM orders)"""

POINTS = f"""pts AS (
  SELECT c_custkey AS id, -7420000e0 + (c_custkey * 37 % 1280) AS x, 5775000e0 - (c_custkey * 53 % ({ROWS} * 10 + 100)) AS y
  FROM customer)"""

_OFFSETS = ", ".join(f"({i}, {ox}e0, {oy}e0)" for i, (ox, oy) in enumerate(U_SHAPE))

# polygons in grid units (u east, v south), one per supplier
POLYS = f"""off(i, ox, oy) AS (VALUES {_OFFSETS}),
poly AS (
  SELECT s_suppkey AS id, CAST(s_suppkey * 29 % 128 AS DOUBLE) AS cx, CAST(s_suppkey * 17 % {ROWS} AS DOUBLE) AS cy,
         2e0 + (s_suppkey % 5) * 3e0 AS level, 2e0 AS step
  FROM supplier),
edges AS (
  SELECT p.id, p.cx + a.ox AS u1, p.cy + a.oy AS v1, p.cx + b.ox AS u2, p.cy + b.oy AS v2
  FROM poly p, off a JOIN off b ON b.i = a.i + 1),
bbox AS (
  SELECT id, min(least(u1, u2)) AS u0, max(greatest(u1, u2)) AS u9, min(least(v1, v2)) AS v0, max(greatest(v1, v2)) AS v9
  FROM edges GROUP BY id)"""

# every cell position of every stored 32x32 tile (tiles are full; positions past the data are NODATA)
GRID = """tile_rows AS (SELECT unnest(range(0, (max(o_orderkey) // 128 // 32 + 1) * 32)) AS gy FROM orders),
grid AS (SELECT a.gx, t.gy FROM range(0, 128) a(gx), tile_rows t)"""


def dense(raster: str, name: str, scale: str = "") -> str:
    return f"""{name} AS (SELECT g.gx, g.gy, r.value{scale} AS value FROM grid g LEFT JOIN {raster} r ON r.gx = g.gx AND r.gy = g.gy)"""


# brute-force even-odd test of every cell centre in the polygon's bounding box
def cover(raster: str) -> str:
    return f"""cand AS (
  SELECT b.id, r.gx, r.gy, r.value FROM bbox b JOIN {raster} r
    ON r.gx + 0.5 BETWEEN b.u0 AND b.u9 AND r.gy + 0.5 BETWEEN b.v0 AND b.v9),
cover AS (
  SELECT c.id, c.gx, c.gy, c.value FROM cand c JOIN edges e ON e.id = c.id
  GROUP BY c.id, c.gx, c.gy, c.value
  HAVING sum(CASE WHEN (e.v1 > c.gy + 0.5) <> (e.v2 > c.gy + 0.5)
                   AND c.gx + 0.5 < e.u1 + (c.gy + 0.5 - e.v1) * (e.u2 - e.u1) / (e.v2 - e.v1)
                  THEN 1 ELSE 0 END) % 2 = 1)"""


def ratio(n: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN (({n}) * 20000 + ({t})) // (2 * ({t})) / 10000e0 END"


# the cells of a tile past the raster's last are NODATA cells of the polygon too
FLOOD_CLASSES = f"""WITH {HAND_EXTENT}, {GRID}, {dense('hand_extent', 'dhand')}, {POLYS}, {cover('dhand')},
cls AS (
  SELECT c.id, CAST(CASE WHEN c.value < p.level THEN ceil((p.level - c.value) / p.step) ELSE 0 END AS INTEGER) AS class
  FROM cover c JOIN poly p ON p.id = c.id)"""

P10_FLOOD_SUMMARY = f"""{FLOOD_CLASSES},
per AS (SELECT id, count(*) AS total, count(*) FILTER (WHERE class > 0) AS flooded FROM cls GROUP BY id),
share AS (SELECT id, class, count(*) AS n FROM cls GROUP BY id, class),
iv AS (SELECT s.id, '{{' || string_agg('"' || class || '":' || CAST({ratio('s.n', 'p.total')} AS DECIMAL(5, 4)), ',' ORDER BY class) || '}}' AS intervals
       FROM share s JOIN per p ON p.id = s.id GROUP BY s.id),
area AS (SELECT id, CAST(trunc(abs(sum(u1 * v2 - u2 * v1)) / 2 * 100) AS BIGINT) AS area FROM edges GROUP BY id)
SELECT p.id, a.area, CAST(coalesce(per.total, 0) AS BIGINT) AS total, CAST(coalesce(per.flooded, 0) AS BIGINT) AS flooded,
       {ratio('per.flooded', 'per.total')} AS coverage, iv.intervals
FROM poly p JOIN area a ON a.id = p.id LEFT JOIN per ON per.id = p.id LEFT JOIN iv ON iv.id = p.id"""

K2_FLOOD_CLASSES = f"""{FLOOD_CLASSES},
n AS (SELECT id, class, count(*) AS cells FROM cls GROUP BY id, class)
SELECT id, class, cells, {ratio('cells', 'sum(cells) OVER (PARTITION BY id)')} AS ratio FROM n"""

G9_RASTERIZE = f"""WITH {POLYS},
cells AS (SELECT gx, gy FROM range(0, 150) a(gx), (SELECT unnest(range(0, {ROWS} + 20)) AS gy)),
cand AS (
  SELECT b.id, r.gx, r.gy FROM bbox b JOIN cells r
    ON r.gx + 0.5 BETWEEN b.u0 AND b.u9 AND r.gy + 0.5 BETWEEN b.v0 AND b.v9),
cover AS (
  SELECT c.id, c.gx, c.gy FROM cand c JOIN edges e ON e.id = c.id
  GROUP BY c.id, c.gx, c.gy
  HAVING sum(CASE WHEN (e.v1 > c.gy + 0.5) <> (e.v2 > c.gy + 0.5)
                   AND c.gx + 0.5 < e.u1 + (c.gy + 0.5 - e.v1) * (e.u2 - e.u1) / (e.v2 - e.v1)
                  THEN 1 ELSE 0 END) % 2 = 1)
SELECT id, count(*) AS cells, CAST(sum(gx) AS BIGINT) AS sum_gx, CAST(sum(gy) AS BIGINT) AS sum_gy,
       min(gx) AS min_gx, max(gx) AS max_gx, min(gy) AS min_gy, max(gy) AS max_gy
FROM cover GROUP BY id"""

K4_POINT_VALUE = f"""WITH {HAND_EXTENT}, {POINTS}
SELECT p.id, CAST(floor((x + 7420000e0) / 10) AS BIGINT) AS gx, CAST(floor((5775000e0 - y) / 10) AS BIGINT) AS gy, h.value
FROM pts p LEFT JOIN hand_extent h ON h.gx = CAST(floor((x + 7420000e0) / 10) AS BIGINT) AND h.gy = CAST(floor((5775000e0 - y) / 10) AS BIGINT)"""


# --- dense layer grid, 3x3 neighbourhoods, kernels ------------------------------------

import math  # noqa: E402

from relief.functions.color import ASPECT_COLORMAP, DEM_COLORMAP, HAND_COLORMAP  # noqa: E402
from relief.functions.local import exaggeration_factor  # noqa: E402
from relief.sources.fixtures import FIXTURE_ZOOM  # noqa: E402

_NB = {"a": (-1, -1), "b": (0, -1), "c": (1, -1), "d": (-1, 0), "e": (0, 0), "f": (1, 0), "g": (-1, 1), "h": (0, 1), "i": (1, 1)}


def neighbourhood(src: str) -> str:
    cols = ", ".join(f"{n}.value AS {n}" for n in _NB)
    joins = " ".join(
        f"LEFT JOIN {src} {n} ON {n}.gx = z.gx + ({dx}) AND {n}.gy = z.gy + ({dy})" for n, (dx, dy) in _NB.items()
    )
    return f"""nb AS (SELECT z.gx, z.gy, {cols} FROM {src} z {joins})"""


P = "(((c + 2 * f + i) - (a + 2 * d + g)) / 24.0)"
Q = "(((g + 2 * h + i) - (a + 2 * b + c)) / 24.0)"
SLOPE = f"CASE WHEN e IS NULL THEN NULL ELSE degrees(atan(sqrt({P} * {P} + {Q} * {Q}))) END"
ASPECT = f"CASE WHEN e IS NULL THEN NULL WHEN {P} = 0 AND {Q} = 0 THEN -1e0 ELSE fmod(degrees(atan2(-{P}, {Q})) + 360.0, 360.0) END"


def hillshade_sql(altitude: float = 60.0, azimuth: float = 315.0) -> str:
    zen = math.radians(90.0 - altitude)
    az = math.radians(azimuth)
    s = f"atan(sqrt({P} * {P} + {Q} * {Q}))"
    v = f"({math.cos(zen)!r} * cos({s}) + {math.sin(zen)!r} * sin({s}) * cos({az!r} - atan2(-{P}, {Q})))"
    return f"CASE WHEN e IS NULL OR {v} IS NULL THEN NULL ELSE 127.0 * greatest(0.0, {v}) END"


_R2 = repr(math.sqrt(2.0))
_D8 = [("f", 1, False), ("i", 2, True), ("h", 4, False), ("g", 8, True), ("d", 16, False), ("a", 32, True), ("b", 64, False), ("c", 128, True)]


def _drop(n, diag):
    return f"((e - {n}) / {_R2})" if diag else f"(e - {n})"


FLOWDIR = (
    "CASE WHEN " + " OR ".join(f"{n} IS NULL" for n in _NB) + " THEN NULL "
    + "WHEN greatest(" + ", ".join(_drop(n, d) for n, _, d in _D8) + ") <= 0 THEN NULL "
    + " ".join(
        f"WHEN {_drop(n, d)} = greatest(" + ", ".join(_drop(m, dd) for m, _, dd in _D8) + f") THEN {code}e0"
        for n, code, d in _D8
    )
    + " END"
)



def focal_sql(kernel: str) -> str:
    if kernel == "median":
        return f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}, {neighbourhood('ddem')}
SELECT gx, gy, round((SELECT median(x) FROM (SELECT unnest([a, b, c, d, e, f, g, h, i]) AS x)), 6) AS value FROM nb"""
    expr = {"slope": SLOPE, "aspect": ASPECT, "hillshade": hillshade_sql(), "flowdir": FLOWDIR}[kernel]
    return f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}, {neighbourhood('ddem')}
SELECT gx, gy, round({expr}, 6) AS value FROM nb"""


def _cmap(definition: str) -> list[tuple[float, int]]:
    out = []
    for part in definition.split(";"):
        lim, hexa = part.strip().split(":")
        out.append((float(lim), int(hexa, 16)))
    return sorted(out)


def classify_le_sql(v: str, definition: str) -> str:
    cm = _cmap(definition)
    whens = " ".join(f"WHEN {v} <= {lim!r} THEN {col}" for lim, col in cm)
    return f"CAST(CASE WHEN {v} IS NULL THEN 0 {whens} ELSE {cm[-1][1]} END AS BIGINT)"


def classify_ge_sql(v: str, definition: str) -> str:
    cm = _cmap(definition)
    whens = " ".join(f"WHEN {v} >= {lim!r} THEN {col}" for lim, col in reversed(cm))
    return f"CAST(CASE WHEN {v} IS NULL THEN 0 {whens} ELSE {cm[0][1]} END AS BIGINT)"


def normalize_sql(v: str, a, b, c, d) -> str:
    return f"CAST(trunc(({v} - {float(a)!r}) * {float(d - c)!r} / {float(b - a)!r} + {float(c)!r}) AS INTEGER)"


P1_COLOR = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}
SELECT gx, gy, {classify_le_sql('value', DEM_COLORMAP)} AS color FROM ddem"""

P2_GREY = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')},
k AS (SELECT gx, gy, (rank() OVER w - 1) AS r, count(*) OVER w AS n FROM ddem WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY gx // 32, gy // 32 ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cls AS (SELECT gx, gy, CASE WHEN n > 1 THEN r * 254 // (n - 1) ELSE 0 END AS class FROM k),
lvl AS (SELECT gx, gy, (class * 510 + 254) // 508 AS g FROM cls)
SELECT gx, gy, CAST(g * 16777216 + g * 65536 + g * 256 + 255 AS BIGINT) AS color FROM lvl
UNION ALL SELECT gx, gy, CAST(0 AS BIGINT) AS color FROM ddem WHERE value IS NULL"""

P3_CONTOUR = f"""WITH {DEM}, {GRID}, dem4 AS (SELECT gx, gy, trunc(value / 4.0) AS value FROM dem), {dense('dem4', 'ddem')}, {neighbourhood('ddem')}
SELECT gx, gy, {FLOWDIR} AS value FROM nb"""

_HS = exaggeration_factor(FIXTURE_ZOOM, "hillshade")
_SL = exaggeration_factor(FIXTURE_ZOOM, "slope")

P4_HILLSHADE = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem', f' * {_HS!r}')}, {neighbourhood('ddem')}
SELECT gx, gy, CASE WHEN e IS NULL THEN 0 ELSE {normalize_sql(hillshade_sql(), 0, 127, 1, 254)} END AS value FROM nb"""

P5_ASPECT = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}, {neighbourhood('ddem')},
asp AS (SELECT gx, gy, {ASPECT} AS v FROM nb)
SELECT gx, gy, {classify_ge_sql('v', ASPECT_COLORMAP)} AS color FROM asp"""

P6_SLOPE = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem', f' * {_SL!r}')}, {neighbourhood('ddem')}
SELECT gx, gy, CASE WHEN e IS NULL THEN 0 ELSE {normalize_sql(SLOPE, 0, 100, 1, 254)} END AS value FROM nb"""

P7_COLOR_HILLSHADE = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem', f' * {_HS!r}')}, {neighbourhood('ddem')},
parts AS (SELECT n.gx, n.gy, d.value AS src, {normalize_sql(hillshade_sql(), 0, 127, 1, 254)} AS shade
          FROM nb n JOIN (SELECT g.gx, g.gy, r.value FROM grid g LEFT JOIN dem r ON r.gx = g.gx AND r.gy = g.gy) d
          ON d.gx = n.gx AND d.gy = n.gy),
base AS (SELECT gx, gy, src, shade, {classify_le_sql('src', DEM_COLORMAP)} AS c FROM parts)
SELECT gx, gy, CAST(CASE WHEN src IS NULL THEN 0 WHEN shade IS NULL THEN NULL ELSE
       4278190080 + (greatest(((c >> 16) & 255) - (255 - shade), 1) << 16)
                  + (greatest(((c >> 8) & 255) - (255 - shade), 1) << 8)
                  + greatest((c & 255) - (255 - shade), 1) END AS BIGINT) AS color FROM base"""

P8_HAND = f"""WITH {HAND_EXTENT}, {HAND_DEPTH},
req AS (SELECT s_suppkey AS id, s_suppkey % 4 AS col, (s_suppkey * 7 + 1) % (({ROWS} + 31) // 32) AS row, (s_suppkey % 10) + 1e0 AS level FROM supplier),
tiles AS (SELECT DISTINCT gx // 32 AS col, gy // 32 AS row FROM hand_extent),
cells AS (SELECT r.id, r.level, r.col * 32 + p.i % 32 AS gx, r.row * 32 + p.i // 32 AS gy
          FROM req r JOIN tiles t ON t.col = r.col AND t.row = r.row, range(0, 1024) p(i)),
v AS (SELECT c.id, c.gx, c.gy,
             CASE WHEN e.value = 0 THEN NULL WHEN e.value <= c.level AND e.value > -1 THEN c.level - d.value ELSE NULL END AS depth
      FROM cells c LEFT JOIN hand_extent e ON e.gx = c.gx AND e.gy = c.gy LEFT JOIN hand_depth d ON d.gx = c.gx AND d.gy = c.gy)
SELECT id, gx, gy, {classify_le_sql('depth', HAND_COLORMAP)} AS color FROM v"""


# --- visibility --------------------------------------------------------------------

def observers_sql(radius: int, height: float = 200.0, raster: str = "dem") -> str:
    return f"""obs0 AS (SELECT s_suppkey AS id, s_suppkey * 37 % 128 AS ox, s_suppkey * 53 % {ROWS} AS oy,
                  {height!r} AS height, {int(radius)} AS r FROM supplier),
obs AS (SELECT o.id, o.ox, o.oy, d.value + o.height AS oz, o.r FROM obs0 o JOIN {raster} d ON d.gx = o.ox AND d.gy = o.oy
        WHERE d.value IS NOT NULL)"""


def rays_sql(step: int = 1) -> str:
    return f"""rays AS (SELECT id, ox, oy, oz, r, unnest(range(0, 8 * r, {int(step)})) AS t FROM obs),
dir AS (SELECT id, ox, oy, oz, r, t,
               CASE t // (2 * r) WHEN 0 THEN -r + (t - (t // (2 * r)) * 2 * r) WHEN 1 THEN r
                    WHEN 2 THEN r - (t - (t // (2 * r)) * 2 * r) ELSE -r END AS dx,
               CASE t // (2 * r) WHEN 0 THEN -r WHEN 1 THEN -r + (t - (t // (2 * r)) * 2 * r)
                    WHEN 2 THEN r ELSE r - (t - (t // (2 * r)) * 2 * r) END AS dy FROM rays),
st AS (SELECT id, ox, oy, oz, r, t, dx, dy, unnest(range(1, r + 1)) AS k FROM dir),
sm AS (SELECT id, t, k, oz, CAST(floor((2 * k * dx + r) / (2.0 * r)) AS BIGINT) AS sx,
              CAST(floor((2 * k * dy + r) / (2.0 * r)) AS BIGINT) AS sy, ox, oy FROM st)"""


def r2_sql(surface: str, keyed: bool = False) -> str:
    on = "AND c.id = s.id" if keyed else ""
    return f"""samp AS (SELECT s.id, s.t, s.k, s.ox + s.sx AS gx, s.oy + s.sy AS gy,
                (c.value - s.oz) / sqrt(s.sx * s.sx + s.sy * s.sy) AS slope
         FROM sm s JOIN {surface} c ON c.gx = s.ox + s.sx AND c.gy = s.oy + s.sy {on} WHERE c.value IS NOT NULL),
seen AS (SELECT id, gx, gy, slope, max(slope) OVER (PARTITION BY id, t ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hz
         FROM samp),
vs AS (SELECT id, gx, gy, max(vis) AS vis FROM (
         SELECT id, gx, gy, CASE WHEN hz IS NULL OR slope >= hz THEN 1 ELSE 0 END AS vis FROM seen
         UNION ALL SELECT id, ox, oy, 1 FROM obs) u GROUP BY id, gx, gy)"""


V2_VIEWSHED = f"""WITH {DEM}, {observers_sql(20)}, {rays_sql()}, {r2_sql('dem')}
SELECT id, gx, gy, vis FROM vs"""


def ring_sql(surface: str, keyed: bool = False) -> str:
    """V4: a recursion over rings.  Each of the four sides of ring k is a list by offset -k..k; offset t looks through the
    same side of ring k - 1 at t * (k - 1) / k.  Cells without a value pass the horizon on.  ``looked``: id, gx, gy, vis."""
    on = "AND c.id = p.id" if keyed else ""
    inner = "CAST(floor(t * (k - 1) / CAST(k AS DOUBLE)) AS BIGINT)"
    rest = f"(t * (k - 1) - {inner} * k)"
    low, high, f = f"h[{inner} + k]", f"h[{inner} + k + 1]", f"({rest} / CAST(k AS DOUBLE))"
    return f"""rk AS (SELECT id, ox, oy, oz, unnest(range(1, CAST(r AS BIGINT) + 1)) AS k FROM obs),
sd AS (SELECT *, unnest([0, 1, 2, 3]) AS s FROM rk),
pt AS (SELECT *, unnest(range(-k, k + 1)) AS t FROM sd),
pos AS (SELECT id, s, k, t, oz, ox + CASE s WHEN 0 THEN k WHEN 2 THEN -k ELSE t END AS gx, oy + CASE s WHEN 1 THEN k WHEN 3 THEN -k ELSE t END AS gy FROM pt),
side AS (SELECT p.id, p.s, p.k, list((c.value - p.oz) / sqrt(CAST(p.k * p.k + p.t * p.t AS DOUBLE)) ORDER BY p.t) AS sl
         FROM pos p LEFT JOIN {surface} c ON c.gx = p.gx AND c.gy = p.gy {on} GROUP BY p.id, p.s, p.k),
w AS (
  SELECT id, s, k, sl AS h, [CASE WHEN x IS NULL THEN NULL ELSE 1 END FOR x IN sl] AS vis FROM side WHERE k = 1
  UNION ALL
  SELECT id, s, k,
         [CASE WHEN sl[i] IS NULL THEN hin[i] WHEN hin[i] IS NULL OR sl[i] > hin[i] THEN sl[i] ELSE hin[i] END FOR i IN range(1, 2 * k + 2)],
         [CASE WHEN sl[i] IS NULL THEN NULL WHEN hin[i] IS NULL OR sl[i] >= hin[i] THEN 1 ELSE 0 END FOR i IN range(1, 2 * k + 2)]
  FROM (SELECT id, s, k, sl, [CASE WHEN {rest} = 0 OR {high} IS NULL THEN {low} WHEN {low} IS NULL THEN {high}
                                   ELSE {low} * (1 - {f}) + {high} * {f} END FOR t IN range(-k, k + 1)] AS hin
        FROM (SELECT d.id, d.s, d.k, d.sl, w.h FROM w JOIN side d ON d.id = w.id AND d.s = w.s AND d.k = w.k + 1))),
seen4 AS (SELECT id, s, k, unnest(range(-k, k + 1)) AS t, unnest(vis) AS vis FROM w),
looked AS (
  SELECT o.id, o.ox + CASE s WHEN 0 THEN k WHEN 2 THEN -k ELSE t END AS gx, o.oy + CASE s WHEN 1 THEN k WHEN 3 THEN -k ELSE t END AS gy, vis
  FROM seen4 v JOIN obs o ON o.id = v.id WHERE vis IS NOT NULL AND (s IN (0, 2) OR abs(t) < k)
  UNION ALL SELECT id, ox, oy, 1 FROM obs)"""


V4_VIEWSHED_APPROX = f"""WITH RECURSIVE {DEM}, {observers_sql(20)}, {ring_sql('dem')}
SELECT id, gx, gy, vis FROM looked"""

V3_VIEWSHED_EXACT = f"""WITH {DEM}, {observers_sql(6)},
sq AS (SELECT id, ox, oy, oz, r, unnest(range(-r, r + 1)) AS dx FROM obs),
sq2 AS (SELECT id, ox, oy, oz, r, dx, unnest(range(-r, r + 1)) AS dy FROM sq),
tg AS (SELECT q.id, q.ox, q.oy, q.oz, q.dx, q.dy, greatest(abs(q.dx), abs(q.dy)) AS m, q.ox + q.dx AS gx, q.oy + q.dy AS gy,
              (c.value - q.oz) / sqrt(q.dx * q.dx + q.dy * q.dy) AS ts
       FROM sq2 q JOIN dem c ON c.gx = q.ox + q.dx AND c.gy = q.oy + q.dy
       WHERE (q.dx <> 0 OR q.dy <> 0) AND c.value IS NOT NULL),
stp AS (SELECT id, ox, oy, oz, dx, dy, m, gx, gy, unnest(range(1, m)) AS k FROM tg WHERE m > 1),
geo AS (SELECT id, gx AS tx, gy AS ty, oz, k, abs(dx) >= abs(dy) AS xmaj,
               k * (CASE WHEN abs(dx) >= abs(dy) THEN dy ELSE dx END) AS num, m, ox, oy,
               sign(CASE WHEN abs(dx) >= abs(dy) THEN dx ELSE dy END) * k AS kmaj FROM stp),
geo2 AS (SELECT *, CAST(floor(num / CAST(m AS DOUBLE)) AS BIGINT) AS lo FROM geo),
geo3 AS (SELECT *, (num - lo * m) / CAST(m AS DOUBLE) AS frac,
                sqrt(CAST(k * k AS DOUBLE) + pow(num / CAST(m AS DOUBLE), 2)) AS dist FROM geo2),
c0 AS (SELECT g.*, CASE WHEN xmaj THEN ox + kmaj ELSE ox + lo END AS x0, CASE WHEN xmaj THEN oy + lo ELSE oy + kmaj END AS y0,
              CASE WHEN xmaj THEN ox + kmaj ELSE ox + lo + 1 END AS x1, CASE WHEN xmaj THEN oy + lo + 1 ELSE oy + kmaj END AS y1
       FROM geo3 g),
zs AS (SELECT c0.id, c0.tx, c0.ty, c0.oz, c0.dist,
              CASE WHEN c0.frac = 0 THEN a.value * 1.0 ELSE a.value * (1 - c0.frac) + b.value * c0.frac END AS z
       FROM c0 LEFT JOIN dem a ON a.gx = c0.x0 AND a.gy = c0.y0 LEFT JOIN dem b ON b.gx = c0.x1 AND b.gy = c0.y1),
hz AS (SELECT id, tx, ty, max((z - oz) / dist) AS h FROM zs WHERE z IS NOT NULL GROUP BY id, tx, ty)
SELECT t.id, t.gx, t.gy, CASE WHEN h.h IS NULL OR t.ts >= h.h THEN 1 ELSE 0 END AS vis
FROM tg t LEFT JOIN hz h ON h.id = t.id AND h.tx = t.gx AND h.ty = t.gy
UNION ALL SELECT id, ox, oy, 1 FROM obs"""

# All DSM cells of the tiles within buff (200 m) of each observer; the radius reaches the farthest of them
P11_SURFACE = f"""obs1 AS (SELECT s_suppkey AS id, s_suppkey * 37 % 128 AS ox, s_suppkey * 53 % {ROWS} AS oy, 200.0 AS height FROM supplier),
tk AS (SELECT o.id, c.col, c.row FROM obs1 o,
          (SELECT DISTINCT gx // 32 AS col, gy // 32 AS row FROM dsm) c
        WHERE pow(greatest(-7420000e0 + c.col * 320e0 - (-7420000e0 + (o.ox + 0.5) * 10e0), 0e0,
                           (-7420000e0 + (o.ox + 0.5) * 10e0) - (-7420000e0 + c.col * 320e0 + 320e0)), 2)
            + pow(greatest((5775000e0 - c.row * 320e0 - 320e0) - (5775000e0 - (o.oy + 0.5) * 10e0), 0e0,
                           (5775000e0 - (o.oy + 0.5) * 10e0) - (5775000e0 - c.row * 320e0)), 2) <= 200e0 * 200e0),
surf AS (SELECT t.id, d.gx, d.gy, d.value FROM tk t JOIN dsm d ON d.gx // 32 = t.col AND d.gy // 32 = t.row),
obs AS (SELECT o.id, any_value(o.ox) AS ox, any_value(o.oy) AS oy, any_value(d.value + o.height) AS oz,
               max(greatest(abs(f.gx - o.ox), abs(f.gy - o.oy))) AS r
        FROM obs1 o JOIN dem d ON d.gx = o.ox AND d.gy = o.oy JOIN surf f ON f.id = o.id WHERE d.value IS NOT NULL GROUP BY o.id)"""

P11_MEDIAN = f"""{DEM}, {DSM}, {P11_SURFACE}, {ring_sql('surf', keyed=True)},
fv AS (SELECT id, gx, gy, CAST(vis AS DOUBLE) AS value FROM looked),
med AS (SELECT z.id, z.gx, z.gy,
               (SELECT median(x) FROM (SELECT unnest([a.value, b.value, c.value, d.value, z.value, f.value, g.value, h.value, i.value]) AS x)) AS m
        FROM fv z
        LEFT JOIN fv a ON a.id = z.id AND a.gx = z.gx - 1 AND a.gy = z.gy - 1
        LEFT JOIN fv b ON b.id = z.id AND b.gx = z.gx AND b.gy = z.gy - 1
        LEFT JOIN fv c ON c.id = z.id AND c.gx = z.gx + 1 AND c.gy = z.gy - 1
        LEFT JOIN fv d ON d.id = z.id AND d.gx = z.gx - 1 AND d.gy = z.gy
        LEFT JOIN fv f ON f.id = z.id AND f.gx = z.gx + 1 AND f.gy = z.gy
        LEFT JOIN fv g ON g.id = z.id AND g.gx = z.gx - 1 AND g.gy = z.gy + 1
        LEFT JOIN fv h ON h.id = z.id AND h.gx = z.gx AND h.gy = z.gy + 1
        LEFT JOIN fv i ON i.id = z.id AND i.gx = z.gx + 1 AND i.gy = z.gy + 1),
lv AS (SELECT id, gx, gy, CAST(floor(m + 0.5) AS BIGINT) AS idx FROM med)"""

P11_VIEWSHED_MASK = f"""WITH RECURSIVE {P11_MEDIAN},
gl AS (SELECT id, gx, gy, (idx * 510 + 1) // 2 AS gg FROM lv)
SELECT id, gx, gy, CAST(gg * 16777216 + gg * 65536 + gg * 256 + 255 AS BIGINT) AS color FROM gl"""


# --- outlines: unit sides, ranked by pointer doubling -----------------------------------


def rings_sql(rounds: int = 17) -> str:
    """From ``rc`` (id, gx, gy, v): ``polygons`` (id, region, value, geojson).

    Every cell has four directed sides, with the cell on the right; sides that two cells of one value share fall out.  A side
    is followed by the one to its right, else ahead, else to its left.  After ``rounds`` doublings every side of a ring of up to
    2 ** ``rounds`` sides knows the ring's least side and its distance to it.  A hole belongs to the region of the cell above its least
    corner; the left end of that cell's run lies on another ring of the region, and so on up to the outer ring."""
    doubled = [
        f"""g{k + 1} AS (SELECT a.id, a.sid, b.nxt, CASE WHEN b.mn < a.mn THEN b.mn ELSE a.mn END AS mn, CASE WHEN b.mn < a.mn THEN {2**k} + b.d ELSE a.d END AS d
              FROM g{k} a JOIN g{k} b ON b.id = a.id AND b.sid = a.nxt)"""
        for k in range(rounds)
    ]
    near = [(0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)]
    corner = {0: ("gx", "gy", "gx + 1", "gy"), 1: ("gx + 1", "gy", "gx + 1", "gy + 1"), 2: ("gx + 1", "gy + 1", "gx", "gy + 1"), 3: ("gx", "gy + 1", "gx", "gy")}
    sides = " UNION ALL ".join(
        f"""SELECT c.id, c.v, c.gx AS cx, c.gy AS cy, {d} AS dir, {', '.join('c.' + e for e in corner[d][:1])} AS x0, c.{corner[d][1]} AS y0, c.{corner[d][2]} AS x1, c.{corner[d][3]} AS y1
            FROM rc c LEFT JOIN rc n ON n.id = c.id AND n.gx = c.gx + ({dx}) AND n.gy = c.gy + ({dy}) AND n.v = c.v WHERE n.gx IS NULL"""
        for d, dx, dy in near
    )
    return f"""sides0 AS ({sides}),
-- two regions can have a side at one place: the cell tells them apart
sid AS (SELECT id, v, cx, cy, dir, x0, y0, x1, y1, row_number() OVER (PARTITION BY id ORDER BY y0, x0, dir, v, cy, cx) AS sid FROM sides0),
follow AS (
  SELECT a.id, a.sid, b.sid AS nxt, row_number() OVER (PARTITION BY a.id, a.sid ORDER BY CASE (b.dir - a.dir + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS choice
  FROM sid a JOIN sid b ON b.id = a.id AND b.x0 = a.x1 AND b.y0 = a.y1 AND b.v = a.v
   AND (((b.dir - a.dir + 4) % 4 = 1 AND b.cx = a.cx AND b.cy = a.cy)
     OR ((b.dir = a.dir) AND b.cx = a.cx + CASE a.dir WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AND b.cy = a.cy + CASE a.dir WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)
     OR ((b.dir - a.dir + 4) % 4 = 3 AND b.cx = a.cx + CASE a.dir WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE -1 END AND b.cy = a.cy + CASE a.dir WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE -1 END))),
g0 AS (SELECT id, sid, nxt, sid AS mn, 0 AS d FROM follow WHERE choice = 1),
{', '.join(doubled)},
ranked AS (SELECT s.*, g.mn, count(*) OVER (PARTITION BY s.id, g.mn) AS n, g.d FROM sid s JOIN g{rounds} g ON g.id = s.id AND g.sid = s.sid),
placed AS (SELECT *, (n - d) % n AS place FROM ranked),
turned AS (SELECT *, lag(dir) OVER (PARTITION BY id, mn ORDER BY place) AS before FROM placed),
corners AS (SELECT id, mn, place, x0, y0 FROM turned WHERE before IS NULL OR before <> dir),
ring AS (SELECT id, mn, any_value(v) AS v, sum(x0 * y1 - x1 * y0) / 2.0 AS area, arg_min(x0, place) AS lx, arg_min(y0, place) AS ly FROM placed GROUP BY id, mn),
path AS (SELECT id, mn, string_agg('[' || (-7420000.0::DOUBLE + x0 * 10.0::DOUBLE)::VARCHAR || ',' || (5775000.0::DOUBLE - y0 * 10.0::DOUBLE)::VARCHAR || ']', ',' ORDER BY place) AS p FROM corners GROUP BY id, mn),
-- the left end of each cell's run
rs0 AS (SELECT id, gx, gy, v, CASE WHEN lag(gx) OVER w = gx - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS nw FROM rc WINDOW w AS (PARTITION BY id, gy ORDER BY gx)),
rs AS (SELECT id, gx, gy, max(CASE WHEN nw = 1 THEN gx END) OVER (PARTITION BY id, gy ORDER BY gx ROWS UNBOUNDED PRECEDING) AS gx0 FROM rs0),
up AS (SELECT h.id, h.mn, o.mn AS parent FROM ring h JOIN rs ON rs.id = h.id AND rs.gx = h.lx AND rs.gy = h.ly - 1
       JOIN placed o ON o.id = h.id AND o.dir = 3 AND o.cx = rs.gx0 AND o.cy = h.ly - 1 WHERE h.area < 0),
climb AS (SELECT id, mn, mn AS top FROM ring UNION ALL SELECT c.id, c.mn, u.parent FROM climb c JOIN up u ON u.id = c.id AND u.mn = c.top),
outer_ring AS (SELECT c.id, c.mn, c.top FROM climb c JOIN ring r ON r.id = c.id AND r.mn = c.top WHERE r.area > 0),
polygons AS (
  SELECT o.id, any_value(t.ly * 4294967296 + t.lx) AS region, any_value(t.v) AS value,
         '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[' || string_agg('[' || p.p || ',' || split_part(p.p, '],', 1) || CASE WHEN contains(p.p, '],') THEN ']' ELSE '' END || ']', ',' ORDER BY abs(r.area) DESC, r.ly, r.lx)
         || ']}},"properties":{{"value":' || any_value(t.v)::VARCHAR || '}}}}' AS geojson
  FROM outer_ring o JOIN ring r ON r.id = o.id AND r.mn = o.mn JOIN path p ON p.id = o.id AND p.mn = o.mn JOIN ring t ON t.id = o.id AND t.mn = o.top
  GROUP BY o.id, o.top)"""


# --- regions (recursive closure over row runs) ------------------------------------------

Z1_REGIONS = f"""WITH RECURSIVE {DEM},
q AS (SELECT gx, gy, CAST(floor(value / 100) AS DOUBLE) AS v FROM dem WHERE value IS NOT NULL),
r0 AS (SELECT gx, gy, v, CASE WHEN lag(gx) OVER w = gx - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS nw
       FROM q WINDOW w AS (PARTITION BY gy ORDER BY gx)),
r1 AS (SELECT gx, gy, v, sum(nw) OVER (PARTITION BY gy ORDER BY gx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM r0),
runs AS (SELECT gy, grp, min(gx) AS gx0, max(gx) AS gx1, any_value(v) AS v, gy * 4294967296 + min(gx) AS run FROM r1 GROUP BY gy, grp),
cr AS (SELECT c.gx, c.gy, c.v, r.run FROM r1 c JOIN runs r ON r.gy = c.gy AND r.grp = c.grp),
e AS (SELECT DISTINCT a.run AS a, b.run AS b FROM cr a JOIN cr b ON b.gx = a.gx AND b.gy = a.gy + 1 AND b.v = a.v),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT run, run FROM runs UNION SELECT r.a, ee.b FROM reach r JOIN ee ON ee.a = r.b),
lab AS (SELECT a AS run, min(b) AS region FROM reach GROUP BY a)
SELECT l.region, any_value(r.v) AS value, CAST(sum(r.gx1 - r.gx0 + 1) AS BIGINT) AS cells
FROM runs r JOIN lab l ON l.run = r.run GROUP BY l.region"""


Z3_REGION_POLYGONS = f"""WITH RECURSIVE {DEM}, rc AS (SELECT 0 AS id, gx, gy, CAST(floor(value / 100) AS DOUBLE) AS v FROM dem WHERE value IS NOT NULL), {rings_sql()}
SELECT region, value, geojson FROM polygons"""

P12_VIEWSHED_POLYGONS = f"""WITH RECURSIVE {P11_MEDIAN}, rc AS (SELECT id, gx, gy, CAST(idx AS DOUBLE) AS v FROM lv WHERE idx <> 0), {rings_sql()}
SELECT id, region, value, geojson FROM polygons"""


# --- sources, geometry and local rows ----------------------------------------------

TILE_REQ = f"""treq AS (SELECT s_suppkey AS id, CAST(s_suppkey % 6 - 1 AS INTEGER) AS col,
                       CAST(s_suppkey * 7 % (({ROWS} + 31) // 32 + 2) - 1 AS INTEGER) AS row FROM supplier),
dtiles AS (SELECT gx // 32 AS col, gy // 32 AS row, count(value) AS valid_cells,
                  string_agg(coalesce(CAST(CAST(value AS BIGINT) AS VARCHAR), 'x'), ' ' ORDER BY gy, gx) AS cells FROM ddem GROUP BY 1, 2)"""

S2_TILE_LOOKUP = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}, {TILE_REQ}
SELECT r.id, r.col, r.row, CAST(t.valid_cells AS INTEGER) AS valid_cells, t.cells
FROM treq r LEFT JOIN dtiles t ON t.col = r.col AND t.row = r.row"""

S3_LAYER_METADATA = f"""WITH {DEM}, kb AS (SELECT CAST(min(gx // 32) AS INTEGER) AS col_min, CAST(min(gy // 32) AS INTEGER) AS row_min,
                           CAST(max(gx // 32) AS INTEGER) AS col_max, CAST(max(gy // 32) AS INTEGER) AS row_max,
                           count(DISTINCT gy // 32 * 1000 + gx // 32) AS tiles, count(value) AS valid_cells, min(value) AS value_min, max(value) AS value_max FROM dem)
SELECT 'dem' AS layer, {FIXTURE_ZOOM} AS zoom, 'EPSG:3857' AS crs, 'int32' AS cell_type, -2147483648e0 AS nodata, 32 AS tile_cols, 32 AS tile_rows,
       -7420000e0 + col_min * 320e0 AS xmin, 5775000e0 - (row_max + 1) * 320e0 AS ymin,
       -7420000e0 + (col_max + 1) * 320e0 AS xmax, 5775000e0 - row_min * 320e0 AS ymax,
       col_min, row_min, col_max, row_max, tiles, valid_cells, value_min, value_max FROM kb"""

S4_KEY_BOUNDS = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}, {TILE_REQ},
kb AS (SELECT min(gx // 32) AS c0, min(gy // 32) AS r0, max(gx // 32) AS c1, max(gy // 32) AS r1 FROM dem)
SELECT r.id, r.col, r.row FROM treq r, kb WHERE r.col BETWEEN kb.c0 AND kb.c1 AND r.row BETWEEN kb.r0 AND kb.r1"""

_LAT = "((c_custkey * 53 % 1700) / 10.0 - 85.0)"
_LON = "((c_custkey * 37 % 3600) / 10.0 - 180.0)"
_MX = f"round(radians({_LON}) * 6378137.0, 4)"
_MY = f"round(ln(tan({math.pi / 4!r} + radians({_LAT}) / 2)) * 6378137.0, 4)"

S5_POINT_REQUESTS = f"""SELECT c_custkey AS id,
       CASE c_custkey % 3 WHEN 0 THEN {_MX} WHEN 1 THEN round(-7420000e0 + c_custkey, 4) END AS x,
       CASE c_custkey % 3 WHEN 0 THEN {_MY} WHEN 1 THEN round(5775000e0 - c_custkey, 4) END AS y,
       c_custkey % 3 <> 2 AS valid
FROM customer"""

G1_REPROJECT = f"""SELECT c_custkey AS id, {_MX} AS x, {_MY} AS y FROM customer"""

S7_COLLECTION_POLYGON = f"""WITH {POLYS}
SELECT id, {len(U_SHAPE)} AS vertices, CAST(trunc(abs(sum(u1 * v2 - u2 * v1)) / 2 * 100) AS BIGINT) AS area FROM edges GROUP BY id"""

S9_PACK = f"""WITH {DEM}
SELECT CAST(gx // 32 AS INTEGER) AS col, CAST(gy // 32 AS INTEGER) AS row, count(value) AS cells, sum(value) AS total
FROM dem GROUP BY 1, 2 HAVING count(value) > 0"""

# every tile of the bounding box against every edge (clipped to the tile by its parameter) and its centre against the polygon
G6_POLYGON_TILES = f"""WITH {POLYS},
es AS (SELECT s.scale, id, u1 * s.scale / 32 AS u1, v1 * s.scale / 32 AS v1, u2 * s.scale / 32 AS u2, v2 * s.scale / 32 AS v2 FROM edges, (VALUES (1), (40)) s(scale)),
bb AS (SELECT scale, id, CAST(floor(min(least(u1, u2))) AS BIGINT) AS c0, CAST(floor(max(greatest(u1, u2))) AS BIGINT) AS c1,
              CAST(floor(min(least(v1, v2))) AS BIGINT) AS r0, CAST(floor(max(greatest(v1, v2))) AS BIGINT) AS r1 FROM es GROUP BY scale, id),
bc AS (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM bb),
tk AS (SELECT scale, id, col, unnest(range(r0, r1 + 1)) AS row FROM bc),
cl AS (SELECT t.scale, t.id, t.col, t.row, e.v1, e.v2, e.u1, e.u2,
              CASE WHEN u1 = u2 THEN CASE WHEN u1 BETWEEN col AND col + 1 THEN 0 ELSE 2 END ELSE least((col - u1) / (u2 - u1), (col + 1 - u1) / (u2 - u1)) END AS tu0,
              CASE WHEN u1 = u2 THEN 1 ELSE greatest((col - u1) / (u2 - u1), (col + 1 - u1) / (u2 - u1)) END AS tu1,
              CASE WHEN v1 = v2 THEN CASE WHEN v1 BETWEEN row AND row + 1 THEN 0 ELSE 2 END ELSE least((row - v1) / (v2 - v1), (row + 1 - v1) / (v2 - v1)) END AS tv0,
              CASE WHEN v1 = v2 THEN 1 ELSE greatest((row - v1) / (v2 - v1), (row + 1 - v1) / (v2 - v1)) END AS tv1
       FROM tk t JOIN es e ON e.scale = t.scale AND e.id = t.id)
SELECT CAST(scale AS INTEGER) AS scale, id, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row FROM cl GROUP BY scale, id, col, row
HAVING bool_or(greatest(tu0, tv0, 0) <= least(tu1, tv1, 1))
    OR sum(CASE WHEN (v1 > row + 0.5) <> (v2 > row + 0.5) AND col + 0.5 < u1 + (row + 0.5 - v1) * (u2 - u1) / (v2 - v1) THEN 1 ELSE 0 END) % 2 = 1"""

G7_BUFFER_TILES = f"""WITH obs AS (SELECT s_suppkey AS id, -7420000e0 + (s_suppkey * 37 % 128 + 0.5) * 10e0 AS x,
                     5775000e0 - (s_suppkey * 53 % {ROWS} + 0.5) * 10e0 AS y FROM supplier),
keys AS (SELECT id, x, y, unnest(range(CAST(floor((x - 200 + 7420000e0) / 320) AS BIGINT),
                                       CAST(floor((x + 200 + 7420000e0) / 320) AS BIGINT) + 1)) AS col,
                floor((5775000e0 - y - 200) / 320) AS r0, floor((5775000e0 - y + 200) / 320) AS r1 FROM obs),
keys2 AS (SELECT id, x, y, col, unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT) + 1)) AS row FROM keys)
SELECT id, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row FROM keys2
WHERE pow(greatest((-7420000e0 + col * 320e0) - x, 0e0, x - (-7420000e0 + col * 320e0 + 320e0)), 2)
    + pow(greatest((5775000e0 - row * 320e0 - 320e0) - y, 0e0, y - (5775000e0 - row * 320e0)), 2) <= 40000e0"""

L2_COMBINE = f"""WITH {DEM}, {DSM}
SELECT s.gx, s.gy, s.value - d.value AS value FROM dsm s JOIN dem d ON d.gx = s.gx AND d.gy = s.gy"""

L2_COMBINE_TILES = f"""WITH {DEM}, {DSM}, {GRID}
SELECT g.gx, g.gy, s.value - d.value AS value FROM grid g LEFT JOIN dsm s ON s.gx = g.gx AND s.gy = g.gy LEFT JOIN dem d ON d.gx = g.gx AND d.gy = g.gy"""

V1_OBSERVERS = f"""WITH {DEM}, {observers_sql(20)} SELECT id, ox, oy, oz FROM obs"""

P13_FIXED_CELL_VIEWSHED = f"""WITH {DEM},
f AS (SELECT min(CASE WHEN gy = 5 AND value IS NOT NULL THEN gx END) AS ox, CAST(greatest(max(gx), max(gy)) AS INTEGER) AS r FROM dem),
obs AS (SELECT CAST(0 AS BIGINT) AS id, d.gx AS ox, d.gy AS oy, d.value + 0.0 AS oz, f.r FROM dem d JOIN f ON d.gx = f.ox AND d.gy = 5),
{rays_sql()}, {r2_sql('dem')}
SELECT id, gx, gy, vis FROM vs"""


# --- local rows, crop, quantiles, neighbourhoods -------------------------------------------

L3_EXAGGERATE = f"""WITH {DEM} SELECT gx, gy, round(value * {_HS!r}, 6) AS value FROM dem"""
L4_CONTOUR = f"""WITH {DEM} SELECT gx, gy, value / 4 AS value FROM dem"""
L5_NORMALIZE = f"""WITH {DEM} SELECT gx, gy, {normalize_sql('value', 0, 500, 1, 254)} AS value FROM dem"""
L6_MASK = f"""WITH {DEM}, {DSM}
SELECT s.gx, s.gy, CASE WHEN d.value IS NULL THEN 0e0 ELSE s.value END AS value
FROM dsm s JOIN dem d ON d.gx = s.gx AND d.gy = s.gy"""
L7_ZERO_NODATA = f"""WITH {HAND_EXTENT} SELECT gx, gy, CASE WHEN value = 0 THEN NULL ELSE value END AS value FROM hand_extent"""
L8_OVERRIDE = f"""WITH {DEM}, {observers_sql(20)},
ov AS (SELECT ox AS gx, oy AS gy, max(oz) AS oz FROM obs GROUP BY ox, oy)
SELECT d.gx, d.gy, CASE WHEN ov.oz IS NOT NULL THEN ov.oz ELSE d.value END AS value
FROM dem d LEFT JOIN ov ON ov.gx = d.gx AND ov.gy = d.gy"""
L9_FLOOD_DEPTH = P8_HAND.replace(f"SELECT id, gx, gy, {classify_le_sql('depth', HAND_COLORMAP)} AS color FROM v", "SELECT id, gx, gy, depth AS value FROM v")
M3_CROP = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}
SELECT gx, gy, value FROM ddem WHERE gx BETWEEN 30 AND 97 AND gy BETWEEN 4 AND 90"""
K5_QUANTILE_CLASS = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')},
k AS (SELECT gx, gy, value, rank() OVER w - 1 AS r, count(value) OVER w AS n FROM ddem
      WINDOW w AS (PARTITION BY gx // 32, gy // 32 ORDER BY value ASC NULLS LAST
                   RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT gx, gy, CAST(CASE WHEN value IS NULL THEN NULL WHEN n > 1 THEN r * 254 // (n - 1) ELSE 0 END AS INTEGER) AS class FROM k"""
M1_STITCH = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}
SELECT gx, gy, CASE WHEN (gx // 32 + 2 * (gy // 32)) % 5 = 3 THEN NULL ELSE value END AS value FROM ddem"""
S8_ARRAY_RASTER = f"""WITH {DEM}, {GRID}, {dense('dem', 'ddem')}
SELECT CAST(gx // 32 AS INTEGER) AS col, CAST(gy // 32 AS INTEGER) AS row, gx % 32 AS gx, gy % 32 AS gy, value FROM ddem"""
S12_REQUEST_STREAM = f"""WITH {HAND_EXTENT}, {POINTS},
ok AS (SELECT id, CAST(floor((x + 7420000e0) / 10) AS BIGINT) AS gx, CAST(floor((5775000e0 - y) / 10) AS BIGINT) AS gy FROM pts WHERE id % 7 <> 0)
SELECT p.id, p.gx, p.gy, h.value, CAST(NULL AS VARCHAR) AS reason FROM ok p LEFT JOIN hand_extent h ON h.gx = p.gx AND h.gy = p.gy
UNION ALL SELECT id, NULL, NULL, NULL, 'bad_request' FROM pts WHERE id % 7 = 0"""
# a range join of values with the parsed classes of their map
S10_COLORMAPS = f"""WITH {DEM},
maps AS (SELECT CAST(s_suppkey AS VARCHAR) AS name,
           CASE WHEN s_suppkey % 16 = 0 THEN '10:xyz;20:ff' WHEN s_suppkey % 16 = 4 THEN '10;20:ff' WHEN s_suppkey % 16 = 8 THEN '10:ff:1' WHEN s_suppkey % 4 = 0 THEN 'ten:ff'
                ELSE (s_suppkey % 90) || ':ff0000ff ; ' || (s_suppkey % 90 + 100) || ':00FF00;' || (s_suppkey % 90 + 250) || '.5:80c06000' END AS definition
         FROM supplier WHERE s_suppkey % 10 <> 9),
parts AS (SELECT name, trim(unnest(string_split(definition, ';'))) AS part FROM maps),
entries AS (SELECT name, TRY_CAST(split_part(part, ':', 1) AS DOUBLE) AS lim, regexp_full_match(part, '[^:]*:[0-9a-fA-F]{{1,8}}') AS ok, split_part(part, ':', 2) AS hexa FROM parts),
sound AS (SELECT name FROM entries GROUP BY name HAVING bool_and(ok AND lim IS NOT NULL)),
cm AS (SELECT e.name, e.lim, ('0x' || e.hexa)::BIGINT AS color FROM entries e JOIN sound s ON s.name = e.name),
last AS (SELECT name, arg_max(color, lim) AS color FROM cm GROUP BY name),
vals AS (SELECT c_custkey AS id, CAST(c_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS VARCHAR) AS name, d.value
         FROM customer LEFT JOIN dem d ON d.gx = c_custkey % 128 AND d.gy = c_custkey // 128)
SELECT v.id, any_value(v.name) AS name, any_value(v.value) AS value,
       CAST(CASE WHEN any_value(l.color) IS NULL THEN NULL WHEN any_value(v.value) IS NULL THEN 0 ELSE coalesce(arg_min(c.color, c.lim), any_value(l.color)) END AS BIGINT) AS color
FROM vals v LEFT JOIN last l ON l.name = v.name LEFT JOIN cm c ON c.name = v.name AND v.value <= c.lim GROUP BY v.id"""
# V4 inside the tile under each point, from its cell (20, 20)
P13_FIXED_CELL_APPROX = f"""WITH RECURSIVE {DEM}, {POINTS},
asked AS (SELECT CAST(floor((x + 7420000e0) / 320) AS BIGINT) AS col, CAST(floor((5775000e0 - y) / 320) AS BIGINT) AS row, count(*) AS requests FROM pts GROUP BY 1, 2),
obs AS (SELECT a.row * 1000 + a.col AS id, a.col * 32 + 20 AS ox, a.row * 32 + 20 AS oy, d.value + 2.0 AS oz, 20 AS r, a.requests
        FROM asked a JOIN dem d ON d.gx = a.col * 32 + 20 AND d.gy = a.row * 32 + 20 WHERE d.value IS NOT NULL),
surf AS (SELECT o.id, d.gx, d.gy, d.value FROM obs o JOIN dem d ON d.gx // 32 = o.ox // 32 AND d.gy // 32 = o.oy // 32),
{ring_sql('surf', keyed=True)}
SELECT l.gx, l.gy, CAST(l.vis AS INTEGER) AS vis, o.requests FROM looked l JOIN obs o ON o.id = l.id"""
F0_NEIGHBOURHOOD = f"""WITH {DEM}, {neighbourhood('dem')} SELECT * FROM nb"""
