"""Registered queries of the point-cloud operators, each with the SQL that its rows are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Vec, axis_distance, canonical_plane, inplane_basis, signed_distance
from ..operators import constructs as C
from ..operators import frames, layers, maps, planes, regions, stats
from ..scratch import materialize
from ..session import ship_package
from ..sources import clouds
from . import sqlgeom as S

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None, name: str | None = None):
    def wrap(f: Query) -> Query:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        _QUERIES[key] = run
        if sql:
            _SQL[key] = sql
        return f

    return wrap


def r6(c: Column, name: str, digits: int = 6) -> Column:
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


class _Names(Vec):
    """A Vec of column names that become Columns when they are read, as a session must be there by then."""

    def __init__(self, *names: str):
        object.__setattr__(self, "_names", names)

    x = property(lambda self: F.col(self._names[0]))
    y = property(lambda self: F.col(self._names[1]))
    z = property(lambda self: F.col(self._names[2]))


P = _Names("x", "y", "z")
PS = S.vec("x", "y", "z")
#: A plane, an axis, a circle and a frame that several queries share.
N = (2 / 3, -1 / 3, 2 / 3)
D = -40.0
AXIS_POINT, AXIS = (200.0, 900.0, 48.0), (0.6, 0.0, 0.8)
ROTATION = [[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]
ORIGIN = (10.0, -20.0, 30.0)
U, W = S.basis(N)


def _from(cloud: str) -> str:
    return f"({clouds.SQL[cloud]})"


_DIST = f"({S.dot(PS, S.lit(*N))} + CAST({D} AS DOUBLE))"
_REL = S.sub(PS, S.lit(*AXIS_POINT))
_T = S.dot(_REL, S.lit(*AXIS))
_RHO = f"sqrt(greatest({S.dot(_REL, _REL)} - {_T}*{_T}, 0))"


@_register(f"SELECT point_id, {S.out(_DIST, 'signed')}, {S.out(f'abs({_DIST})', 'dist')} FROM {_from('cloud_orders')}")
def plane_signed_distance(spark, d):
    s = signed_distance(P, Vec.of(*N), F.lit(D))
    return clouds.cloud_orders(spark, d).select("point_id", r6(s, "signed"), r6(F.abs(s), "dist"))


@_register(
    "WITH e AS (SELECT point_id, x - 150 AS a, y - 1200 AS b, z * 20 - 900 AS c FROM " + _from("cloud_orders") + ")"
    f" SELECT point_id, {S.out('a / ' + S.norm(('a', 'b', 'c')) + ' * ' + S.sign(('a', 'b', 'c')), 'nx')}, {S.out('b / ' + S.norm(('a', 'b', 'c')) + ' * ' + S.sign(('a', 'b', 'c')), 'ny')},"
    f" {S.out('c / ' + S.norm(('a', 'b', 'c')) + ' * ' + S.sign(('a', 'b', 'c')), 'nz')}, {S.out('7 / ' + S.norm(('a', 'b', 'c')) + ' * ' + S.sign(('a', 'b', 'c')), 'd')} FROM e"
)
def plane_canonicalise(spark, d):
    n, off = canonical_plane(Vec(P.x - 150, P.y - 1200, P.z * 20 - 900), F.lit(7.0))
    return clouds.cloud_orders(spark, d).select("point_id", r6(n.x, "nx"), r6(n.y, "ny"), r6(n.z, "nz"), r6(off, "d"))


_UV = [S.dot(S.sub(PS, S.lit(150, 1000, 50)), S.lit(*b)) for b in (U, W)]


@_register(f"SELECT point_id FROM {_from('cloud_orders')} WHERE abs({_DIST}) <= 60 AND sqrt({_UV[0]}*{_UV[0]} + {_UV[1]}*{_UV[1]}) <= 600")
def slab_filter(spark, d):
    return regions.slab(clouds.cloud_orders(spark, d), Vec.of(*N), F.lit(D), 60.0, Vec.of(150, 1000, 50), 600.0).select("point_id")


@_register(f"SELECT point_id FROM {_from('cloud_orders')} WHERE (x-250)*(x-250) + (y-2300)*(y-2300) + (z-48)*(z-48) <= 6400")
def radius_query(spark, d):
    return regions.ball(clouds.cloud_orders(spark, d), Vec.of(250, 2300, 48), 80.0).select("point_id")


@_register(f"SELECT point_id, {S.out(_RHO, 'dist')} FROM {_from('cloud_orders')}", "axis_distance")
def axis_distance_query(spark, d):
    return clouds.cloud_orders(spark, d).select("point_id", r6(axis_distance(P, Vec.of(*AXIS_POINT), Vec.of(*AXIS)), "dist"))


@_register(f"SELECT point_id FROM {_from('cloud_orders')} WHERE abs({_RHO} - 300) <= 45 AND abs({_T}) <= 300")
def cylinder_shell(spark, d):
    width, length = regions.shell_size(300.0)
    return regions.cylinder_shell(clouds.cloud_orders(spark, d), Vec.of(*AXIS_POINT), Vec.of(*AXIS), 300.0, width, length).select("point_id")


@_register(f"SELECT point_id, {S.out(f'{_RHO} - 150', 'residual')} FROM {_from('cloud_orders')}")
def cylinder_residual(spark, d):
    return clouds.cloud_orders(spark, d).select("point_id", r6(axis_distance(P, Vec.of(*AXIS_POINT), Vec.of(*AXIS)) - 150.0, "residual"))


_AU, _AW = S.basis(AXIS)
_X2, _X1 = S.dot(_REL, S.lit(*_AW)), S.dot(_REL, S.lit(*_AU))


@_register(f"SELECT point_id, {S.out(f'sqrt({_X1}*{_X1} + {_X2}*{_X2}) - 125', 'residual')} FROM {_from('cloud_orders')}")
def circle_residual(spark, d):
    return clouds.cloud_orders(spark, d).select("point_id", r6(frames.circle_residual(P, Vec.of(*AXIS_POINT), Vec.of(*AXIS), 250.0), "residual"))


@_register(
    f"SELECT point_id, {', '.join(S.out(S.dot(S.sub(PS, S.lit(*ORIGIN)), S.lit(*row)), n) for row, n in zip(ROTATION, 'xyz', strict=True))} FROM {_from('cloud_orders')}"
)
def frame_apply(spark, d):
    q = frames.frame_apply(P, ROTATION, ORIGIN)
    return clouds.cloud_orders(spark, d).select("point_id", r6(q.x, "x"), r6(q.y, "y"), r6(q.z, "z"))


@_register(
    f"SELECT point_id, {', '.join(S.out(f'{S.dot(PS, S.lit(*col))} + ({o})', n) for col, o, n in zip(zip(*ROTATION, strict=True), ORIGIN, 'xyz', strict=True))} FROM {_from('cloud_orders')}"
)
def frame_inverse(spark, d):
    q = frames.frame_inverse(P, ROTATION, ORIGIN)
    return clouds.cloud_orders(spark, d).select("point_id", r6(q.x, "x"), r6(q.y, "y"), r6(q.z, "z"))


_PUV = [S.dot(PS, S.lit(*b)) for b in (U, W)]


@_register(f"SELECT point_id, {S.out(_PUV[0], 'u')}, {S.out(_PUV[1], 'v')} FROM {_from('cloud_orders')}")
def inplane_uv(spark, d):
    u, v = inplane_basis(Vec.of(*N))
    return clouds.cloud_orders(spark, d).select("point_id", r6(P.dot(u), "u"), r6(P.dot(v), "v"))


@_register(f"SELECT point_id FROM {_from('cloud_orders')} WHERE {_PUV[0]} BETWEEN 1500 AND 2300 AND {_PUV[1]} BETWEEN -1000 AND -600")
def uv_rect_select(spark, d):
    u, v = inplane_basis(Vec.of(*N))
    return regions.rectangle(clouds.cloud_orders(spark, d), P.dot(u), P.dot(v), (1500.0, 2300.0), (-1000.0, -600.0)).select("point_id")


_STATS = "grp, count(r) AS n, {mean}, {mad}, {mx}, {std}, {rms}, {p95}".format(
    mean=S.out("avg(r)", "mean"), mad=S.out("1.4826 * median(abs(r - med))", "mad_sigma"), mx=S.out("max(abs(r))", "max_abs"),
    std=S.out("stddev_pop(r)", "std"), rms=S.out("sqrt(avg(r*r))", "rms"), p95=S.out("quantile_cont(abs(r), 0.95)", "p95_abs"),
)


@_register(
    f"WITH r AS (SELECT grp, {_DIST} AS r FROM {_from('cloud_orders')}), m AS (SELECT grp, median(r) AS med FROM r GROUP BY grp)"
    f" SELECT {_STATS} FROM r JOIN m USING (grp) GROUP BY grp"
)
def residual_stats(spark, d):
    out = stats.residual_stats(clouds.cloud_orders(spark, d), signed_distance(P, Vec.of(*N), F.lit(D)), ["grp"])
    return out.select("grp", "n", *(r6(F.col(c), c) for c in out.columns[2:]))


@_register(
    f"WITH r AS (SELECT grp, z - x AS r FROM {_from('cloud_part')}), m AS (SELECT grp, median(r) AS med FROM r GROUP BY grp)"
    f" SELECT grp, {S.out('1.4826 * median(abs(r - med))', 'mad_sigma')} FROM r JOIN m USING (grp) GROUP BY grp"
)
def mad_sigma(spark, d):
    return stats.residual_stats(clouds.cloud_part(spark, d), F.col("z") - F.col("x"), ["grp"]).select("grp", r6(F.col("mad_sigma"), "mad_sigma"))


@_register(
    "SELECT grp, count(*) AS n, " + ", ".join(S.out(f"covar_pop({a}, {b})", f"c{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + ", "
    + ", ".join(S.out(f"avg({a})", f"m{a}") for a in "xyz") + f" FROM {_from('cloud_lineitem')} GROUP BY grp"
)
def scatter_matrix(spark, d):
    m = clouds.cloud_lineitem(spark, d).groupBy("grp").agg(*planes.moment_columns())
    return m.select("grp", "n", *(r6(F.col(c), c) for c in m.columns[2:]))


@_register(
    f"WITH m AS (SELECT grp, {S.MOMENTS} FROM {_from('cloud_embeddings')} GROUP BY grp), {S.eigen('m', 'grp', 'e')}"
    f" SELECT grp, n, {S.out('vx', 'nx', 5)}, {S.out('vy', 'ny', 5)}, {S.out('vz', 'nz', 5)}, {S.out('-(vx*mx + vy*my + vz*mz)', 'd', 4)} FROM e"
)
def plane_fit_lsq(spark, d):
    fits = planes.fit_planes(clouds.cloud_embeddings(spark, d), "grp")
    return fits.select("grp", "n", r6(F.col("nx"), "nx", 5), r6(F.col("ny"), "ny", 5), r6(F.col("nz"), "nz", 5), r6(F.col("d"), "d", 4))


@_register(
    f"WITH m AS (SELECT grp, {S.MOMENTS} FROM {_from('cloud_part')} GROUP BY grp), {S.eigen('m', 'grp', 'e', True)}"
    f" SELECT grp, n, {S.out('vx', 'ux', 5)}, {S.out('vy', 'uy', 5)}, {S.out('vz', 'uz', 5)} FROM e"
)
def pca_axis(spark, d):
    axes = planes.principal_axes(clouds.cloud_part(spark, d), "grp")
    return axes.select("grp", "n", *(r6(F.col(c), c, 5) for c in ("ux", "uy", "uz")))


@_register(
    f"WITH s AS (SELECT grp, count(*) AS n, avg(x) AS mu, avg(y) AS mv, avg(x*x + y*y) AS mw, covar_pop(x, x) AS uu, covar_pop(y, y) AS vv, covar_pop(x, y) AS uv,"
    f" covar_pop(x, x*x + y*y) AS uw, covar_pop(y, x*x + y*y) AS vw FROM {_from('cloud_part')} GROUP BY grp),"
    " c AS (SELECT *, (uw*vv - vw*uv) / (2*(uu*vv - uv*uv)) AS cu, (vw*uu - uw*uv) / (2*(uu*vv - uv*uv)) AS cv FROM s)"
    f" SELECT grp, n, {S.out('cu', 'cu')}, {S.out('cv', 'cv')}, {S.out('sqrt(mw - 2*(cu*mu + cv*mv) + cu*cu + cv*cv)', 'radius')} FROM c"
)
def kasa_circle_fit(spark, d):
    fits = stats.circle_sums(clouds.cloud_part(spark, d), F.col("x"), F.col("y"), ["grp"])
    return fits.select("grp", "n", *(r6(F.col(c), c) for c in ("cu", "cv", "radius")))


@_register(
    f"WITH c AS ({clouds.SQL['cloud_orders']}), lo AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM c)"
    " SELECT min(point_id) AS point_id, count(*) AS cnt FROM c, lo GROUP BY floor((x-x0)/25), floor((y-y0)/25), floor((z-z0)/25)"
)
def voxel_downsample(spark, d):
    return stats.voxel_downsample(clouds.cloud_orders(spark, d), 25.0)


@_register(
    f"WITH c AS ({clouds.SQL['cloud_orders']}), lo AS (SELECT min(x) AS x0, min(y) AS y0 FROM c)"
    " SELECT CAST(floor((x-x0)/10) AS BIGINT) AS iu, CAST(floor((y-y0)/40) AS BIGINT) AS iv, count(*) AS cnt FROM"
    " (SELECT c.x AS x, c.y AS y, x0, y0 FROM c, lo) GROUP BY 1, 2 HAVING count(*) >= 4"
)
def voxel_occupancy(spark, d):
    cloud = clouds.cloud_orders(spark, d)
    (x0, _), (y0, _) = stats.extents(cloud, F.col("x"), F.col("y"))
    return stats.occupancy(cloud, F.col("x"), F.col("y") / 4, (x0, y0 / 4), 10.0, 4)


def _bin(value: str, lo: str, hi: str, bins: int) -> str:
    return f"CAST(least(floor((({value}) - ({lo})) / (({hi}) - ({lo})) * {bins}), {bins - 1}) AS BIGINT)"


@_register(f"SELECT {_bin(_DIST, '-300', '300', 81)} AS bin, count(*) AS cnt FROM {_from('cloud_orders')} WHERE abs({_DIST}) <= 300 GROUP BY 1")
def residual_hist(spark, d):
    return stats.residual_histogram(clouds.cloud_orders(spark, d), signed_distance(P, Vec.of(*N), F.lit(D)), 300.0)


@_register(
    f"WITH c AS (SELECT {_PUV[0]} AS u, {_PUV[1]} AS v, {_DIST} AS r FROM {_from('cloud_orders')}), e AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM c)"
    f" SELECT {_bin('u', 'u0', 'u1', 20)} AS iu, {_bin('v', 'v0', 'v1', 20)} AS iv, count(*) AS cnt, {S.out('avg(r)', 'mean')} FROM c, e GROUP BY 1, 2"
)
def uv_residual_map(spark, d):
    cloud = clouds.cloud_orders(spark, d)
    u, v = inplane_basis(Vec.of(*N))
    (u0, u1), (v0, v1) = stats.extents(cloud, P.dot(u), P.dot(v))
    out = stats.mean_map(cloud, P.dot(u), P.dot(v), signed_distance(P, Vec.of(*N), F.lit(D)), (u0, u1, v0, v1), 20)
    return out.select("iu", "iv", "cnt", r6(F.col("mean"), "mean"))


#: Uneven edges of a map's cells, in u and in v.
_EDGES = ([-1800 + 1.5 * k * k for k in range(60)], [-2300 + 7 * k + 0.25 * k * k for k in range(80)])


def _edge_sql(value: str, edges: list[float]) -> str:
    listed = f"[{', '.join(f'CAST({float(e)!r} AS DOUBLE)' for e in edges)}]"
    return f"CAST(least(len(list_filter({listed}, lambda e: e <= {value})), {len(edges) - 1}) - 1 AS BIGINT)"


@_register(
    f"WITH c AS (SELECT {_PUV[0]} AS u, {_PUV[1]} AS v, {_DIST} AS r FROM {_from('cloud_orders')})"
    f" SELECT {_edge_sql('u', _EDGES[0])} AS iu, {_edge_sql('v', _EDGES[1])} AS iv, count(*) AS cnt, {S.out('avg(r)', 'mean')} FROM c"
    f" WHERE u BETWEEN {_EDGES[0][0]} AND {_EDGES[0][-1]} AND v BETWEEN {_EDGES[1][0]} AND {_EDGES[1][-1]} GROUP BY 1, 2"
)
def edge_map(spark, d):
    """A residual map on given, uneven edges."""
    from ..operators.selection import map_on_edges

    u, v = inplane_basis(Vec.of(*N))
    out = map_on_edges(clouds.cloud_orders(spark, d), P.dot(u), P.dot(v), signed_distance(P, Vec.of(*N), F.lit(D)), *_EDGES)
    return out.select("iu", "iv", "cnt", r6(F.col("mean"), "mean"))


@_register(
    f"SELECT count(*) AS n_used, count(*) FILTER (WHERE abs({_DIST}) > 300) AS n_outside, CAST(300 AS DOUBLE) AS threshold FROM {_from('cloud_orders')}"
)
def residual_hist_summary(spark, d):
    return stats.histogram_summary(clouds.cloud_orders(spark, d), signed_distance(P, Vec.of(*N), F.lit(D)), 300.0)


_FACE = planes.Plane.of(N, 0.0)
#: The face's coordinates are squares of integers, so that no point lies on the border of a cell of a prime number.
_FACE_SQL = f"WITH c AS {_from('turned_face')}, e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(r) AS r0, max(r) AS r1, avg(a) AS ma, avg(b) AS mb, avg(r) AS mr FROM c)"


@_register(f"{_FACE_SQL} SELECT {_bin('a', 'a0', 'a1', 19)} AS iu, {_bin('b', 'b0', 'b1', 19)} AS iv, count(*) AS cnt, {S.out('avg(r)', 'mean')} FROM c, e GROUP BY 1, 2")
def aligned_uv_map(spark, d):
    out = maps.residual_uv_map(clouds.turned_face(spark, d), _FACE, 19)
    return out.cells.select("iu", "iv", "cnt", r6(F.col("mean"), "mean"))


@_register(
    f"{_FACE_SQL} SELECT * FROM (SELECT 'u' AS axis, {S.out('2 / 3', 'x')}, {S.out('2 / 3', 'y')}, {S.out('-1 / 3', 'z')}, {S.out('a0 - ma', 'low')}, {S.out('a1 - ma', 'high')} FROM e"
    f" UNION ALL SELECT 'v', {S.out('-1 / 3', 'x')}, {S.out('2 / 3', 'y')}, {S.out('2 / 3', 'z')}, {S.out('b0 - mb', 'low')}, {S.out('b1 - mb', 'high')} FROM e"
    f" UNION ALL SELECT 'n', {S.out('2 / 3', 'x')}, {S.out('-1 / 3', 'y')}, {S.out('2 / 3', 'z')}, {S.out('r0 - mr', 'low')}, {S.out('r1 - mr', 'high')} FROM e)"
)
def aligned_extents(spark, d):
    out = maps.residual_uv_map(clouds.turned_face(spark, d), _FACE, 19)
    rows = [(k, *(round(c, 6) + 0.0 for c in (*axis, out.low[i], out.high[i]))) for i, (k, axis) in enumerate(zip("uvn", (out.frame.u, out.frame.v, out.frame.n), strict=True))]
    return spark.createDataFrame(rows, "axis string, x double, y double, z double, low double, high double")


_SZ = f"SELECT 150 * atan2({_X2}, {_X1}) AS s, {_T} AS h, sqrt({_X1}*{_X1} + {_X2}*{_X2}) - 150 AS r FROM {_from('cloud_orders')}"


@_register(
    f"WITH c AS ({_SZ}), e AS (SELECT min(s) AS s0, max(s) AS s1, min(h) AS h0, max(h) AS h1 FROM c)"
    f" SELECT {_bin('s', 's0', 's1', 16)} AS iu, {_bin('h', 'h0', 'h1', 16)} AS iv, count(*) AS cnt, {S.out('avg(r)', 'mean')} FROM c, e GROUP BY 1, 2"
)
def cyl_sz_map(spark, d):
    cloud = clouds.cloud_orders(spark, d)
    s, h, r = frames.unrolled(P, Vec.of(*AXIS_POINT), Vec.of(*AXIS), 150.0)
    (s0, s1), (h0, h1) = stats.extents(cloud, s, h)
    out = stats.mean_map(cloud, s, h, r, (s0, s1, h0, h1), 16)
    return out.select("iu", "iv", "cnt", r6(F.col("mean"), "mean"))


@_register(
    "WITH c AS (SELECT (x - 250) / 100 AS r FROM " + _from("cloud_orders") + f"), h AS (SELECT {_bin('r', '-6', '6', 81)} AS bin, count(*) AS cnt FROM c WHERE abs(r) <= 6 GROUP BY 1),"
    " f AS (SELECT b.bin, coalesce(h.cnt, 0) AS cnt FROM range(81) b(bin) LEFT JOIN h ON h.bin = b.bin),"
    " t AS (SELECT *, max(cnt) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM f), p AS (SELECT bin AS peak, cnt AS most FROM f ORDER BY cnt DESC, bin LIMIT 1)"
    " SELECT (SELECT count(*) FROM c) AS n, peak, (SELECT count(*) FROM c) >= 1000 AND bool_or(abs(bin - peak) * 12.0 / 81 > 2 AND cnt > 0.3 * most AND cnt = top) AS bimodal FROM t, p GROUP BY peak"
)
def bimodality(spark, d):
    return stats.bimodality(clouds.cloud_orders(spark, d), (F.col("x") - 250) / 100, 1.0)


def _layer_sql(gap: str, least: int) -> str:
    return (
        f"WITH c AS ({clouds.SQL['depth_events']}), s AS (SELECT *, t - lag(t) OVER w AS step FROM c WINDOW w AS (PARTITION BY grp ORDER BY t, point_id)),"
        f" g AS (SELECT grp, {gap} AS gap FROM s GROUP BY grp),"
        " r AS (SELECT s.*, sum(CASE WHEN step > gap THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY t, point_id ROWS UNBOUNDED PRECEDING) AS run FROM s JOIN g USING (grp)),"
        f" l AS (SELECT grp, run, arg_min(point_id, (t, point_id)) AS seed_id, avg(t) AS depth, count(*) AS n_points FROM r GROUP BY grp, run HAVING count(*) >= {least})"
        f" SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY run) - 1 AS INTEGER) AS layer, seed_id, {S.out('depth', 'depth')}, n_points FROM l"
    )


@_register(_layer_sql("0.15", 2))
def depth_layers(spark, d):
    out = layers.depth_layers(clouds.depth_events(spark, d), ["grp"], 0.15, 2)
    return out.select("grp", "layer", "seed_id", r6(F.col("depth"), "depth"), "n_points")


@_register(_layer_sql("greatest(0.01, 10 * median(step))", 1))
def depth_layers_adaptive(spark, d):
    out = layers.depth_layers(clouds.depth_events(spark, d), ["grp"], None, 1, 0.01)
    return out.select("grp", "layer", "seed_id", r6(F.col("depth"), "depth"), "n_points")


_CELLS = f"SELECT CAST(floor(x / 12) AS BIGINT) AS iu, CAST(floor(y / 60) AS BIGINT) AS iv, count(*) AS cnt FROM {_from('cloud_orders')} GROUP BY 1, 2 HAVING count(*) >= 12"
_LABELS = (
    f"WITH RECURSIVE c AS ({_CELLS}), k AS (SELECT iu, iv, row_number() OVER (ORDER BY iu, iv) AS id FROM c),"
    " e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON (a.iu = b.iu AND abs(a.iv - b.iv) = 1) OR (a.iv = b.iv AND abs(a.iu - b.iu) = 1)),"
    " r AS (SELECT id AS s, id AS t FROM k UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a), m AS (SELECT s, max(t) AS top FROM r GROUP BY s),"
    " l AS (SELECT k.iu, k.iv, CAST(dense_rank() OVER (ORDER BY m.top) AS INTEGER) AS label FROM k JOIN m ON m.s = k.id)"
)


def _cells(spark, d) -> DataFrame:
    return stats.occupancy(clouds.cloud_orders(spark, d), F.col("x"), F.col("y") / 5, (0.0, 0.0), 12.0, 12)


@_register(_LABELS + " SELECT iu, iv, label FROM l")
def grid_components(spark, d):
    return regions.grid_components(_cells(spark, d))


@_register(_LABELS + ", z AS (SELECT label, sum(cnt) AS n FROM l JOIN c USING (iu, iv) GROUP BY label) SELECT label, CAST(n AS BIGINT) AS n FROM z ORDER BY z.n DESC, label LIMIT 1")
def main_component(spark, d):
    cells = _cells(spark, d).persist()
    labels = regions.grid_components(cells)
    label, _ = regions.main_component(cells, labels)
    return cells.join(labels, ["iu", "iv"]).filter(F.col("label") == label).groupBy("label").agg(F.sum("cnt").alias("n"))


@_register(
    f"WITH c AS ({clouds.SQL['cloud_orders']}) SELECT q.point_id AS center_id, c.point_id FROM c q JOIN c ON q.point_id % 100 = 0"
    " AND (c.x-q.x)*(c.x-q.x) + (c.y-q.y)*(c.y-q.y) + (c.z-q.z)*(c.z-q.z) <= 2500"
)
def radius_join(spark, d):
    cloud = clouds.cloud_orders(spark, d)
    centers = cloud.filter("point_id % 100 = 0").withColumnRenamed("point_id", "center_id")
    return regions.radius_join(cloud, centers, 50.0)


@_register(f"SELECT point_id FROM {_from('cloud_orders')} WHERE (x-250)*(x-250) + (y-2300)*(y-2300) + (z-48)*(z-48) <= 6400")
def index_ball(spark, d):
    """A kept index, built once, and one ball of it through key ranges."""
    from ..scratch import scratch_path
    from ..sources.cloudindex import build_index, index_ball as run

    index = build_index(clouds.cloud_orders(spark, d), scratch_path(spark, "index"), 50.0)
    return run(spark, index, (250.0, 2300.0, 48.0), 80.0).select("point_id")


@_register(
    f"WITH c AS ({clouds.SQL['cloud_orders']}) SELECT q.point_id AS center_id, c.point_id FROM c q JOIN c ON q.point_id % 100 = 0"
    " AND (c.x-q.x)*(c.x-q.x) + (c.y-q.y)*(c.y-q.y) + (c.z-q.z)*(c.z-q.z) <= 2500"
)
def index_balls(spark, d):
    """The same index asked for many balls at once."""
    from ..scratch import scratch_path
    from ..sources.cloudindex import build_index, index_balls as run

    cloud = clouds.cloud_orders(spark, d)
    index = build_index(cloud, scratch_path(spark, "index"), 50.0)
    return run(spark, index, cloud.filter("point_id % 100 = 0").withColumnRenamed("point_id", "center_id"), 50.0)


_FRONT = (
    f"WITH c AS ({clouds.SQL['cloud_orders']}), q AS (SELECT k, point_id, y + 100 AS t FROM c, (VALUES (1), (2), (4), (8)) r(k) WHERE y + 100 > 0 AND sqrt((x-250)*(x-250) + (z-48)*(z-48)) <= 10*k),"
    " s AS (SELECT *, t - lag(t) OVER w AS step FROM q WINDOW w AS (PARTITION BY k ORDER BY t, point_id)), g AS (SELECT k, greatest(8, 10 * median(step)) AS gap FROM s GROUP BY k),"
    " r AS (SELECT s.*, sum(CASE WHEN step > gap THEN 1 ELSE 0 END) OVER (PARTITION BY s.k ORDER BY t, point_id ROWS UNBOUNDED PRECEDING) AS run FROM s JOIN g ON g.k = s.k),"
    " l AS (SELECT k, run, arg_min(point_id, (t, point_id)) AS seed_id, avg(t) AS depth, count(*) AS n_points FROM r GROUP BY k, run HAVING count(*) >= 6),"
    " n AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY run) - 1 AS INTEGER) AS layer FROM l),"
    " f AS (SELECT k, count(*) AS m, max(CASE WHEN layer = 0 THEN n_points END) >= 15 AS enough FROM n GROUP BY k),"
    " z AS (SELECT k FROM f ORDER BY enough DESC, CASE WHEN enough THEN 0 ELSE -m END, k LIMIT 1)"
    f" SELECT layer, seed_id, {S.out('depth', 'depth')}, n_points FROM n WHERE k IN (SELECT k FROM z)"
)


@_register(_FRONT)
def front_layers(spark, d):
    out = layers.front_layers(clouds.cloud_orders(spark, d), Vec.of(250, -100, 48), Vec.of(0, 1, 0), 10.0)
    return out.select("layer", "seed_id", r6(F.col("depth"), "depth"), "n_points")


@_register("SELECT DISTINCT CASE WHEN label IN (1, 2, 3) THEN 1 ELSE label END AS group_id, vec_id AS point_id FROM embeddings")
def merge_groups(spark, d):
    members = clouds.cloud_embeddings(spark, d).select(F.col("grp").alias("group_id"), "point_id")
    return regions.merge_groups(members, [1, 2, 3], 1)


@_register(f"SELECT point_id FROM {_from('cloud_orders')} WHERE NOT abs({_DIST}) <= 100")
def peel_antijoin(spark, d):
    cloud = clouds.cloud_orders(spark, d)
    return planes.peel(cloud, regions.slab(cloud, Vec.of(*N), F.lit(D), 100.0)).select("point_id")


@_register(
    "WITH m AS (SELECT p_brand AS group_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS local_idx, p_partkey AS point_id FROM part)"
    " SELECT group_id, point_id FROM m WHERE local_idx % 3 = 0"
)
def source_rebase(spark, d):
    from pyspark.sql import Window

    part = clouds.cloud_part(spark, d).withColumnRenamed("grp", "group_id")
    members = part.select("group_id", "point_id", (F.row_number().over(Window.partitionBy("group_id").orderBy("point_id")) - 1).alias("local_idx"))
    return regions.rebase_to_source(members.filter("local_idx % 3 = 0").select("group_id", "local_idx"), members)


# Constructs and measures over rows of derived entities.

_ENTITY_SQL = (
    "WITH c AS (" + clouds.SQL["cloud_orders"] + "), raw AS (SELECT point_id,"
    " x + 1 AS ax, y / 100 AS ay, z + 2 AS az, x - 50 AS ad, y / 100 + 1 AS bx, z AS by_, x / 10 AS bz, z AS bd,"
    " z + 3 AS cx, x / 10 + 40 AS cy, y / 50 AS cz, CAST(7 AS DOUBLE) AS cd, x AS px, y / 100 AS py, z AS pz, z + 1 AS qx, x AS qy, y / 100 AS qz,"
    " z + 1 AS ux, x / 7 AS uy, CAST(2 AS DOUBLE) AS uz, CAST(1 AS DOUBLE) AS vx, z + 1 AS vy, x / 9 AS vz FROM c), e AS (SELECT point_id, px, py, pz, qx, qy, qz"
    + "".join(
        f", {n[k]} * {S.sign(n)} / {S.norm(n)} AS n{p}{a}" for p, n in (("a", ("ax", "ay", "az")), ("b", ("bx", "by_", "bz")), ("c", ("cx", "cy", "cz"))) for k, a in enumerate("xyz")
    )
    + "".join(f", {dd} * {S.sign(n)} / {S.norm(n)} AS d{p}" for p, n, dd in (("a", ("ax", "ay", "az"), "ad"), ("b", ("bx", "by_", "bz"), "bd"), ("c", ("cx", "cy", "cz"), "cd")))
    + "".join(f", {n[k]} * {S.sign(n)} / {S.norm(n)} AS l{p}{a}" for p, n in (("u", ("ux", "uy", "uz")), ("v", ("vx", "vy", "vz"))) for k, a in enumerate("xyz"))
    + " FROM raw)"
)


def _entities(spark, d) -> DataFrame:
    """One survey a row: planes a, b, c, points p, q and lines u (through p), v (through q)."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    cols: list[Column] = [F.col("point_id")]
    for p, n, off in (("a", Vec(x + 1, y / 100, z + 2), x - 50), ("b", Vec(y / 100 + 1, z, x / 10), z), ("c", Vec(z + 3, x / 10 + 40, y / 50), F.lit(7.0))):
        n, off = canonical_plane(n, off)
        cols += [*n.named(f"n{p}x", f"n{p}y", f"n{p}z"), off.alias(f"d{p}")]
    cols += [*Vec(x, y / 100, z).named("px", "py", "pz"), *Vec(z + 1, x, y / 100).named("qx", "qy", "qz")]
    for p, u in (("u", Vec(z + 1, x / 7, F.lit(2.0))), ("v", Vec(F.lit(1.0), z + 1, x / 9))):
        cols += C.canonical_line(P, u)[1].named(f"l{p}x", f"l{p}y", f"l{p}z")
    return clouds.cloud_orders(spark, d).select(*cols)


class _Plane(tuple):
    """(normal, offset) by column names."""

    def __new__(cls, p: str):
        self = super().__new__(cls, (_Names(f"n{p}x", f"n{p}y", f"n{p}z"), f"d{p}"))
        return self

    def __getitem__(self, i):
        return F.col(tuple.__getitem__(self, 1)) if i == 1 else tuple.__getitem__(self, 0)

    def __iter__(self):
        return iter((self[0], self[1]))


_A, _B, _CC = _Plane("a"), _Plane("b"), _Plane("c")
_PT, _QT = _Names("px", "py", "pz"), _Names("qx", "qy", "qz")
_LU, _LV = (_PT, _Names("lux", "luy", "luz")), (_QT, _Names("lvx", "lvy", "lvz"))
_na, _nb, _nc = (S.vec(f"n{p}x", f"n{p}y", f"n{p}z") for p in "abc")
_p, _q, _lu, _lv = S.vec("px", "py", "pz"), S.vec("qx", "qy", "qz"), S.vec("lux", "luy", "luz"), S.vec("lvx", "lvy", "lvz")


def _construct(name: str, values: Callable[[], dict[str, Column]], sql: dict[str, str], before: str = "", digits: int = 4) -> None:
    text = f"{_ENTITY_SQL}{before} SELECT point_id, {', '.join(S.out(e, n, digits) for n, e in sql.items())} FROM {'k' if before else 'e'}"
    _register(text, name)(lambda spark, d: _entities(spark, d).select("point_id", *(r6(c, n, digits) for n, c in values().items())))


def _v(prefix: str, v: Vec) -> dict[str, Column]:
    return {f"{prefix}x": v.x, f"{prefix}y": v.y, f"{prefix}z": v.z}


def _vs(prefix: str, v: S.V) -> dict[str, str]:
    return {f"{prefix}{a}": e for a, e in zip("xyz", v, strict=True)}


def _hit(p: S.V, u: S.V, n: S.V, d: str) -> S.V:
    return S.sub(p, S.mul(u, f"({S.dot(n, p)} + {d}) / {S.dot(n, u)}"))


def _spin(v: S.V, axis: S.V) -> S.V:
    c, s = "cos(radians(33))", "sin(radians(33))"
    return S.add(S.add(S.mul(v, c), S.mul(S.cross(axis, v), s)), S.mul(axis, f"{S.dot(axis, v)} * (1 - {c})"))


def _pl(plane: C.P) -> dict[str, Column]:
    return {**_v("n", plane[0]), "d": plane[1]}


def _li(line: C.L) -> dict[str, Column]:
    return {**_v("p", line[0]), **_v("u", line[1])}


def _three_points() -> dict[str, Column]:
    center, normal, radius = C.circumcircle(Vec.of(0, 0, 0), _PT, _QT)
    return {**_v("c", center), **_v("u", normal), "diameter": radius * 2}


def _all_constructs() -> None:
    _construct("construct_offset", lambda: _pl(C.offset(_A, 2.5)), {**_vs("n", _na), "d": "da - 2.5"})
    t = S.vec("tx", "ty", "tz")
    k = ", k AS (SELECT *, " + ", ".join(f"{e} AS t{a}" for e, a in zip(S.cross(_na, _nb), "xyz", strict=True)) + " FROM e)"
    point = S.mul(S.sub(S.mul(S.cross(t, _nb), "da"), S.mul(S.cross(t, _na), "db")), f"1 / {S.dot(t, t)}")
    _construct("construct_intersect_planes", lambda: _li(C.intersect_planes(_A, _B)), {**_vs("p", point), **_vs("u", S.mul(t, f"{S.sign(t)} / {S.norm(t)}"))}, k)
    det = S.dot(_na, S.cross(_nb, _nc))
    three = S.add(S.add(S.mul(S.cross(_nb, _nc), "-da"), S.mul(S.cross(_nc, _na), "-db")), S.mul(S.cross(_na, _nb), "-dc"))
    _construct("construct_intersect_three_planes", lambda: _v("p", C.intersect_three_planes(_A, _B, _CC)), _vs("p", S.mul(three, f"1 / {det}")), digits=2)
    _construct("construct_intersect_line_plane", lambda: _v("p", C.intersect_line_plane(_LU, _A)), _vs("p", _hit(_p, _lu, _na, "da")))
    _construct("construct_intersect_normal_plane", lambda: _v("p", C.intersect_normal_plane(_A, _B)), _vs("p", _hit(S.mul(_na, "-da"), _na, _nb, "db")), digits=2)
    _construct("construct_intersect_normal_plane_through", lambda: _v("p", C.intersect_normal_plane(_A, _B, _QT)), _vs("p", _hit(_q, _na, _nb, "db")), digits=2)
    _construct("construct_line_from_point_normal", lambda: _li(C.line_from_point_normal(_PT, _B)), {**_vs("p", _p), **_vs("u", S.mul(_nb, S.sign(_nb)))}, digits=7)
    w = S.sub(_q, _p)
    _construct(
        "construct_line_from_two_points", lambda: _li(C.line_from_two_points(_PT, _QT)),
        {**_vs("p", _p), **{n: f"CASE WHEN {S.dot(w, w)} >= 1e-12 THEN {e} END" for n, e in _vs("u", S.mul(w, f"{S.sign(w)} / {S.norm(w)}")).items()}}, digits=7,
    )
    mid = S.mul(S.add(_hit(_p, _lu, _na, "da"), _hit(_p, _lu, _nb, "db")), "0.5")
    _construct("construct_midpoint_line_planes", lambda: _v("p", C.midpoint_line_planes(_LU, _A, _B)), _vs("p", mid), digits=3)
    _construct("construct_plane_from_plane_point", lambda: _pl(C.plane_from_plane_point(_A, _QT)), {**_vs("n", _na), "d": f"-{S.dot(_na, _q)}"})
    _construct("construct_plane_from_line_point", lambda: _pl(C.plane_from_line_point(_LU, _QT)), {**_vs("n", _lu), "d": f"-{S.dot(_lu, _q)}"})
    t2 = S.vec("tx", "ty", "tz")
    k2 = ", k AS (SELECT *, " + ", ".join(f"{e} AS t{a}" for e, a in zip(S.cross(_lu, _lv), "xyz", strict=True)) + " FROM e)"
    big = f"CASE WHEN {S.dot(t2, t2)} >= 1e-12 THEN "
    _construct(
        "construct_plane_from_two_lines", lambda: _pl(C.plane_from_two_lines(_LU, (_PT, _LV[1]))),
        {**{n: f"{big}{e} END" for n, e in _vs("n", S.mul(t2, f"{S.sign(t2)} / {S.norm(t2)}")).items()}, "d": f"{big}-{S.dot(t2, _p)} * {S.sign(t2)} / {S.norm(t2)} END"}, k2,
    )
    k3 = ", k AS (SELECT *, " + ", ".join(f"{e} AS t{a}" for e, a in zip(_spin(_na, _lu), "xyz", strict=True)) + " FROM e)"
    foot = S.add(_p, _spin(S.sub(S.mul(_na, "-da"), _p), _lu))
    _construct("construct_rotate_plane_about_line", lambda: _pl(C.rotate_plane_about_line(_A, _LU, 33.0)), {**_vs("n", S.mul(t, S.sign(t))), "d": f"-{S.dot(t, foot)} * {S.sign(t)}"}, k3)
    _construct("construct_rotate_point_about_line", lambda: _v("p", C.rotate_point_about_line(_QT, _LU, 33.0)), _vs("p", S.add(_p, _spin(S.sub(_q, _p), _lu))))
    k4 = ", k AS (SELECT *, " + ", ".join(f"{e} AS t{a}" for e, a in zip(_spin(_lv, _lu), "xyz", strict=True)) + " FROM e)"
    _construct("construct_rotate_line_about_line", lambda: _li(C.rotate_line_about_line(_LV, _LU, 33.0)), {**_vs("p", S.add(_p, _spin(S.sub(_q, _p), _lu))), **_vs("u", S.mul(t, S.sign(t)))}, k4)
    _construct("project_point_to_plane", lambda: _v("p", C.project_point_to_plane(_QT, _A)), _vs("p", S.sub(_q, S.mul(_na, f"{S.dot(_na, _q)} + da"))))
    _construct("project_point_to_line", lambda: _v("p", C.project_point_to_line(_QT, _LU)), _vs("p", S.add(_p, S.mul(_lu, S.dot(S.sub(_q, _p), _lu)))))
    _construct("measure_distance_points", lambda: {"value": C.distance_points(_PT, _QT)}, {"value": S.norm(S.sub(_q, _p))}, digits=6)
    _construct("measure_distance_point_plane", lambda: {"value": C.distance_point_plane(_QT, _A)}, {"value": f"abs({S.dot(_na, _q)} + da)"}, digits=6)
    _construct("measure_distance_point_line", lambda: {"value": C.distance_point_line(_QT, _LU)}, {"value": S.norm(S.cross(S.sub(_q, _p), _lu))}, digits=6)
    _construct("measure_angle_planes", lambda: {"value": C.angle_planes(_A, _B)}, {"value": f"degrees(acos(least(1.0, abs({S.dot(_na, _nb)}))))"})
    _construct("measure_angle_lines", lambda: {"value": C.angle_lines(_LU, _LV)}, {"value": f"degrees(acos(least(1.0, abs({S.dot(_lu, _lv)}))))"})
    _construct("measure_angle_line_plane", lambda: {"value": C.angle_line_plane(_LU, _A)}, {"value": f"degrees(asin(least(1.0, abs({S.dot(_lu, _na)}))))"})
    # Three points on a circle: p, q and the origin.
    n = S.cross(_p, _q)
    k5 = ", k AS (SELECT *, " + ", ".join(f"{e} AS t{a}" for e, a in zip(n, "xyz", strict=True)) + " FROM e)"
    rel = S.mul(S.add(S.mul(S.cross(t, _p), S.dot(_q, _q)), S.mul(S.cross(_q, t), S.dot(_p, _p))), f"1 / (2 * {S.dot(t, t)})")
    ok = f"CASE WHEN {S.dot(t, t)} > 1e-18 THEN "
    _construct(
        "three_point_cylinder", _three_points,
        {**{a: f"{ok}{e} END" for a, e in {**_vs("c", rel), **_vs("u", S.mul(t, f"1 / {S.norm(t)}"))}.items()}, "diameter": f"{ok}2 * {S.norm(rel)} END"}, k5, 3,
    )


_all_constructs()


# Iterative estimators.

_HYP = (
    "SELECT p_partkey AS hyp_id, (p_partkey * 37 % 101 - 50) / CAST(100 AS DOUBLE) AS nx0, (p_partkey * 53 % 97 - 48) / CAST(100 AS DOUBLE) AS ny0, CAST(1 AS DOUBLE) AS nz0,"
    " CAST(p_partkey % 80 AS DOUBLE) AS d0 FROM part"
)
_HN = "sqrt(nx0*nx0 + ny0*ny0 + 1)"


@_register(
    f"WITH h AS ({_HYP}), k AS (SELECT hyp_id, nx0/{_HN} AS nx, ny0/{_HN} AS ny, 1/{_HN} AS nz, d0/{_HN} AS d FROM h), c AS ({clouds.SQL['plane_scene']})"
    " SELECT hyp_id, CAST(sum(CASE WHEN abs(nx*x + ny*y + nz*z + d) <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS inliers FROM k, c GROUP BY hyp_id"
)
def hypothesis_scores(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet")
    n = Vec((F.col("p_partkey") * 37 % 101 - 50) / 100, (F.col("p_partkey") * 53 % 97 - 48) / 100, F.lit(1.0))
    size = n.norm()
    hyp = raw.select(F.col("p_partkey").alias("hyp_id"), *n.over(size).named("nx", "ny", "nz"), ((F.col("p_partkey") % 80) / size).alias("d"))
    return planes.score_hypotheses(clouds.plane_scene(spark, d), hyp, 5.0)


def _robust_sql(steps: int, thr: float) -> str:
    text = f"WITH c AS MATERIALIZED ({clouds.SQL['plane_scene']}), m0 AS (SELECT 1 AS k, {S.MOMENTS} FROM c), {S.eigen('m0', 'k', 'e0')}, f0 AS MATERIALIZED (SELECT vx, vy, vz, -(vx*mx + vy*my + vz*mz) AS d FROM e0)"
    for i in range(1, steps + 1):
        text += (
            f", m{i} AS (SELECT 1 AS k, {S.MOMENTS} FROM c, f{i - 1} WHERE abs(vx*x + vy*y + vz*z + d) <= {thr}), {S.eigen(f'm{i}', 'k', f'e{i}')},"
            f" f{i} AS MATERIALIZED (SELECT vx, vy, vz, -(vx*mx + vy*my + vz*mz) AS d FROM e{i})"
        )
    inliers = f"(SELECT count(*) FROM c, f{steps} WHERE abs(vx*x + vy*y + vz*z + d) <= {thr})"
    return f"{text} SELECT {S.out('vx', 'nx', 5)}, {S.out('vy', 'ny', 5)}, {S.out('vz', 'nz', 5)}, {S.out('d', 'd', 4)}, {inliers} AS n_inliers FROM f{steps}"


@_register(_robust_sql(4, 1.5))
def robust_fit_plane(spark, d):
    fit = planes.robust_fit_plane(clouds.plane_scene(spark, d).persist(), 1.5)
    row = (*(float(round(c, 5)) + 0.0 for c in fit.plane.normal), float(round(fit.plane.d, 4)) + 0.0, fit.n_inliers)
    return spark.createDataFrame([row], "nx double, ny double, nz double, d double, n_inliers long")


def _robust_groups_sql(steps: int, thr: float) -> str:
    """The same refits by group; a group that has settled stays where it is."""
    plane = "-(vx*mx + vy*my + vz*mz) AS d"
    text = f"WITH c AS MATERIALIZED ({clouds.SQL['plane_scenes']}), m0 AS (SELECT grp, {S.MOMENTS} FROM c GROUP BY grp), {S.eigen('m0', 'grp', 'e0')}, f0 AS MATERIALIZED (SELECT grp, vx, vy, vz, {plane} FROM e0)"
    for i in range(1, steps + 1):
        text += (
            f", m{i} AS (SELECT c.grp AS grp, {S.MOMENTS} FROM c JOIN f{i - 1} ON f{i - 1}.grp = c.grp WHERE abs(vx*x + vy*y + vz*z + d) <= {thr} GROUP BY c.grp), {S.eigen(f'm{i}', 'grp', f'e{i}')},"
            f" f{i} AS MATERIALIZED (SELECT grp, vx, vy, vz, {plane} FROM e{i})"
        )
    count = f"n AS (SELECT c.grp AS grp, count(*) AS n_inliers FROM c JOIN f{steps} ON f{steps}.grp = c.grp WHERE abs(vx*x + vy*y + vz*z + d) <= {thr} GROUP BY c.grp)"
    return f"{text}, {count} SELECT grp, {S.out('vx', 'nx', 5)}, {S.out('vy', 'ny', 5)}, {S.out('vz', 'nz', 5)}, {S.out('d', 'd', 4)}, n_inliers FROM f{steps} JOIN n USING (grp)"


@_register(_robust_groups_sql(6, 1.5))
def robust_fit_groups(spark, d):
    """Robust planes of all groups in one loop."""
    from ..operators.groupfit import robust_planes

    out = robust_planes(clouds.plane_scenes(spark, d), "grp", 1.5)
    return out.select("grp", r6(F.col("nx"), "nx", 5), r6(F.col("ny"), "ny", 5), r6(F.col("nz"), "nz", 5), r6(F.col("d"), "d", 4), "n_inliers")


@_register()
def fit_groups(spark, d):
    """Fit all: groups 0 to 7 as one plane each, 8 to 10 as several planes, and rings of orders as pipes."""
    from ..operators.extract import MainPlaneParams, MultiPlaneParams
    from ..operators.groupfit import GroupFitParams, fit_groups as run
    from ..operators.rounds import RoundParams

    own = _rings(spark, d, False).select((F.crc32(F.col("grp").cast("binary")) + 100).alias("grp"), "point_id", "x", "y", "z")
    cloud = clouds.plane_scenes(spark, d).unionByName(own)
    groups = cloud.select("grp").distinct().withColumn("fit", F.when(F.col("grp") < 8, "plane").when(F.col("grp") < 11, "multi").otherwise("cylinder"))
    one = MainPlaneParams(ransac_iterations=200, min_points=100, min_points_per_cell=1, cell_size_mm=25.0)
    multi = MultiPlaneParams(one, max_planes=2, min_plane_points=60)
    fits, _ = run(cloud, "grp", groups, GroupFitParams(plane=one, multi=multi, cylinder=RoundParams(ransac_iterations=100)))
    return fits.select("grp", "kind", "entity", "n_points", "status", r6(F.col("nx"), "nx", 4), r6(F.col("ny"), "ny", 4), r6(F.col("nz"), "nz", 4), r6(F.col("diameter_mm"), "diameter_mm", 3))


def _face_row(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "plane_index int, nx double, ny double, nz double, d double, n_points long, status string")


def _face(k: int, face) -> tuple:
    return (k, *(float(round(c, 5)) + 0.0 for c in face.plane.normal), float(round(face.plane.d, 4)) + 0.0, face.n_points, face.status)


@_register()
def ransac_plane(spark, d):
    plane, hits = planes.ransac_plane(clouds.plane_scene(spark, d), 1.5, 300)
    return spark.createDataFrame([(*plane.normal, plane.d, hits)], "nx double, ny double, nz double, d double, inliers long")


@_register()
def extract_main_plane(spark, d):
    from ..operators.extract import MainPlaneParams, extract_main_plane as run

    p = MainPlaneParams(ransac_threshold_mm=0.3, ransac_iterations=300, min_points=300, min_points_per_cell=2, cell_size_mm=8.0)
    return _face_row(spark, [_face(0, run(clouds.plane_scene(spark, d), p))])


@_register()
def extract_planes(spark, d):
    from ..operators.extract import MainPlaneParams, MultiPlaneParams, extract_planes as run

    one = MainPlaneParams(ransac_threshold_mm=0.1, max_threshold_mm=0.15, ransac_iterations=300, min_points=300, min_points_per_cell=1, cell_size_mm=12.0)
    found = run(clouds.plane_scene(spark, d), MultiPlaneParams(one, max_planes=2, min_plane_points=100))
    return _face_row(spark, [_face(f["plane_index"], f["result"]) for f in found])


@_register()
def pick_plane_region(spark, d):
    from ..operators.extract import PickParams, pick_plane_region as run

    p = PickParams(local_radius_mm=30.0, min_neighbor_points=50, min_local_inliers=20, local_ransac_iterations=200, cell_size_mm=12.0, min_points_per_cell=1, max_expand_rounds=6)
    members, _ = run(clouds.plane_scene(spark, d), (100.0, 4.0, 28.0), p)
    return members.select("point_id")


def _rings(spark, d, flat: bool) -> DataFrame:
    """Orders around an axis: radius 40 with a small deterministic noise, grouped by priority."""
    a = F.col("o_orderkey") * 0.61803398875 * 6.283185307179586
    r = F.lit(40.0) + ((F.col("o_orderkey") * 7919) % 101 - 50) / 1000
    z = F.lit(0.0) if flat else (F.col("o_orderkey") % 211 - 105).cast("double")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("point_id"), (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), z.alias("z"))


@_register()
def robust_fit_cylinder(spark, d):
    from ..operators.rounds import RoundParams, fit_cylinders

    return fit_cylinders(_rings(spark, d, False), "grp", RoundParams(threshold_mm=0.5, ransac_iterations=200)).select("grp", "status", r6(F.col("diameter_mm"), "diameter_mm", 3), r6(F.abs("uz"), "uz", 4))


@_register()
def robust_fit_circle(spark, d):
    from ..operators.rounds import RoundParams, fit_circles

    ring = _rings(spark, d, True).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "d": F.lit(0.0)})
    return fit_circles(ring, "grp", RoundParams(ransac_iterations=200)).select("grp", "status", r6(F.col("diameter_mm"), "diameter_mm", 3), r6(F.col("px"), "px", 3), r6(F.col("py"), "py", 3))


_RINGS = (
    "SELECT o_orderpriority AS grp, o_orderkey AS point_id, (40 + ((o_orderkey * 7919) % 101 - 50) / CAST(1000 AS DOUBLE)) * cos(o_orderkey * CAST(0.61803398875 AS DOUBLE) * CAST(6.283185307179586 AS DOUBLE)) AS x,"
    " (40 + ((o_orderkey * 7919) % 101 - 50) / CAST(1000 AS DOUBLE)) * sin(o_orderkey * CAST(0.61803398875 AS DOUBLE) * CAST(6.283185307179586 AS DOUBLE)) AS y, CAST(o_orderkey % 211 - 105 AS DOUBLE) AS z FROM orders"
)


def _pipe_sql(cloud: str) -> str:
    """Algebraic cylinder of each group: main axis, circle across it, half a step to the median."""
    e1 = S.mul(S.vec("-vz * ay", "vz * ax", "vx * ay - vy * ax"), "1 / sqrt(vz*ay*vz*ay + vz*ax*vz*ax + (vx*ay - vy*ax)*(vx*ay - vy*ax))")
    rel, u = S.vec("rx", "ry", "rz"), S.vec("vx", "vy", "vz")
    f1, f2 = S.vec("fx", "fy", "fz"), S.vec("gx", "gy", "gz")
    center = S.add(S.vec("mx", "my", "mz"), S.add(S.mul(f1, "cu"), S.mul(f2, "cv")))
    return (
        f"WITH c AS MATERIALIZED ({cloud}), m AS (SELECT grp, {S.MOMENTS} FROM c GROUP BY grp), {S.eigen('m', 'grp', 'e', True)},"
        " b AS (SELECT *, CASE WHEN abs(vx) > 0.9 THEN 0 ELSE 1 END AS ax, CASE WHEN abs(vx) > 0.9 THEN 1 ELSE 0 END AS ay FROM e),"
        f" f AS (SELECT *, {', '.join(f'{v} AS f{a}' for v, a in zip(e1, 'xyz', strict=True))} FROM b),"
        f" g AS (SELECT *, {', '.join(f'{v} AS g{a}' for v, a in zip(S.cross(u, f1), 'xyz', strict=True))} FROM f),"
        " r AS (SELECT g.*, c.x - mx AS rx, c.y - my AS ry, c.z - mz AS rz FROM c JOIN g ON g.grp = c.grp),"
        f" q AS (SELECT *, {S.dot(rel, f1)} AS a, {S.dot(rel, f2)} AS b FROM r),"
        " s AS (SELECT grp, avg(a*a + b*b) AS mw, covar_pop(a, a) AS uu, covar_pop(b, b) AS vv, covar_pop(a, b) AS uv, covar_pop(a, a*a + b*b) AS uw, covar_pop(b, a*a + b*b) AS vw FROM q GROUP BY grp),"
        " k AS (SELECT grp, mw, (uw*vv - vw*uv) / (2*(uu*vv - uv*uv)) AS cu, (vw*uu - uw*uv) / (2*(uu*vv - uv*uv)) AS cv FROM s),"
        " d AS (SELECT q.grp AS grp, median(sqrt((a - cu)*(a - cu) + (b - cv)*(b - cv))) AS mid FROM q JOIN k ON k.grp = q.grp GROUP BY q.grp)"
        f" SELECT g.grp AS grp, g.n AS n, {', '.join(S.out(e, n, 3) for e, n in zip(center, ('px', 'py', 'pz'), strict=True))}, {S.out('vx', 'ux', 4)}, {S.out('vy', 'uy', 4)}, {S.out('vz', 'uz', 4)},"
        f" {S.out('sqrt(mw + cu*cu + cv*cv) + mid', 'diameter_mm', 3)} FROM g JOIN k ON k.grp = g.grp JOIN d ON d.grp = g.grp"
    )


@_register(_pipe_sql(clouds.SQL["cloud_part"]))
def refine_cylinder(spark, d):
    from ..operators.pipes import refine_cylinders

    out = refine_cylinders(clouds.cloud_part(spark, d), "grp")
    return out.select("grp", "n", *(r6(F.col(c), c, 3) for c in ("px", "py", "pz")), *(r6(F.col(c), c, 4) for c in ("ux", "uy", "uz")), r6(F.col("diameter_mm"), "diameter_mm", 3))


@_register(f"SELECT point_id FROM ({_RINGS}) WHERE (x-40)*(x-40) + y*y + (z-10)*(z-10) <= 8100 AND abs(sqrt(x*x + y*y) - 40) <= 6 AND abs(z - 10) <= 40")
def pick_around_cylinder(spark, d):
    from ..operators.extract import pick_around_cylinder as run

    members, _ = run(_rings(spark, d, False), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), 40.0, 90.0, (40.0, 0.0, 10.0))
    return members.select("point_id")


@_register(f"SELECT point_id FROM ({_RINGS}) WHERE x*x + (y - 40 / CAST(3 AS DOUBLE))*(y - 40 / CAST(3 AS DOUBLE)) + z*z <= 6400 AND abs(sqrt(x*x + y*y) - 40) <= 6 AND abs(z) <= 40")
def pick_cylinder_by_three_points(spark, d):
    from ..operators.extract import pick

    members, _ = pick(_rings(spark, d, False), [(40.0, 0.0, 0.0), (0.0, 40.0, 0.0), (-40.0, 0.0, 0.0)], "cylinder")
    return members.select("point_id")


_PICK_AXIS = S.vec("vx", "vy", "vz")
_PICK_REL = S.sub(S.vec("x", "y", "z"), S.lit(40, 0, 0))
#: The axis goes through the click's place on it, so a point's distance from the axis and along it are those from the click.
_PICK_T = S.dot(_PICK_REL, _PICK_AXIS)
_PICK_MT = S.dot(S.sub(S.lit(40, 0, 0), S.vec("mx", "my", "mz")), _PICK_AXIS)


@_register(
    f"WITH c AS MATERIALIZED (SELECT 1 AS one, point_id, x, y, z FROM ({_RINGS}) WHERE (x-40)*(x-40) + y*y + z*z <= 14400), m AS (SELECT one, {S.MOMENTS} FROM c GROUP BY one), {S.eigen('m', 'one', 'e', True)},"
    f" a AS (SELECT vx, vy, vz, mx, my, mz, 40 - {_PICK_MT} * vx AS ox, -{_PICK_MT} * vy AS oy, -{_PICK_MT} * vz AS oz FROM e),"
    f" r AS (SELECT point_id, {_PICK_T} AS t, {S.dot(S.sub(S.vec('x', 'y', 'z'), S.vec('ox', 'oy', 'oz')), S.sub(S.vec('x', 'y', 'z'), S.vec('ox', 'oy', 'oz')))} AS far,"
    f" {S.dot(S.sub(S.vec('x', 'y', 'z'), S.vec('ox', 'oy', 'oz')), _PICK_AXIS)} AS along FROM c, a)"
    " SELECT point_id FROM r WHERE abs(sqrt(greatest(far - along*along, 0)) - 40) <= 6 AND abs(t) <= 40"
)
def pick_cylinder_region(spark, d):
    from ..operators.extract import pick

    members, _ = pick(_rings(spark, d, False), (40.0, 0.0, 0.0), "cylinder", diameter_mm=80.0)
    return members.select("point_id")


@_register()
def display_sample(spark, d):
    return stats.display_sample(clouds.cloud_orders(spark, d), 25.0, 1000)  # a display cap is the feature


# Recipes.

_BEAM = {
    "version": 1, "units": "mm",
    "faces": {"left": {"from": "group", "name": "left"}, "front": {"from": "group", "name": "front"}, "top": {"from": "group", "group_id": 3}},
    "construct": [
        {"id": "left_in", "op": "offset", "of": "left", "distance_mm": 50}, {"id": "front_in", "op": "offset", "of": "front", "distance_mm": 20},
        {"id": "axis", "op": "intersect_planes", "a": "left_in", "b": "front_in"}, {"id": "target", "op": "intersect_line_plane", "line": "axis", "plane": "top"},
        {"id": "corner", "op": "intersect_three_planes", "a": "left", "b": "front", "c": "top"},
    ],
    "frame": {"axis": "axis", "origin": "corner", "yaw_plane": "left", "yaw_to": "x"},
    "measures": [{"id": "m1", "op": "distance_points", "a": "corner", "b": "target"}, {"id": "m2", "op": "angle_planes", "a": "left", "b": "top"}],
    "export": ["target", "axis"],
}
#: Each order is a survey of the beam, whose faces lie a little further out by its key.  The beam is turned as a
#: whole by the matrix of thirds 2 2 -1 / -1 2 2 / 2 -1 2, so its frame is tilted and has a yaw.
_TURNED = ((2 / 3, 2 / 3, -1 / 3), (-1 / 3, 2 / 3, 2 / 3), (2 / 3, -1 / 3, 2 / 3))


def _beam(spark, d, doc: dict | None = None):
    """(planner, table) of the beam over all surveys."""
    from .recipe import Planner, Recipe, _pack

    key = F.col("o_orderkey")
    offsets = (50 + key % 10, 20 + key % 7, -100 - key % 13)
    faces = [_pack((Vec.of(*n), off.cast("double")), "plane").alias(name) for name, n, off in zip(("left", "front", "top"), _TURNED, offsets, strict=True)]
    surveys = spark.read.parquet(f"{d}/orders.parquet").select(key.alias("point_id"), *faces)
    plan = Planner(Recipe.of(doc or _BEAM), surveys)
    return plan, materialize(plan.run(), "beam")


#: Places along the beam's three normals, from which every entity follows.
_S = "SELECT o_orderkey AS point_id, CAST(o_orderkey % 10 AS DOUBLE) AS a, CAST(o_orderkey % 7 AS DOUBLE) AS b, CAST(o_orderkey % 13 AS DOUBLE) AS c FROM orders"


def _along(p: str, q: str, r: str) -> list[str]:
    return [f"({p}) * CAST({n1!r} AS DOUBLE) + ({q}) * CAST({n2!r} AS DOUBLE) + ({r}) * CAST({n3!r} AS DOUBLE)" for n1, n2, n3 in zip(*_TURNED, strict=True)]


def _entities_sql(entities: dict[str, tuple[str, list[str]]]) -> str:
    parts = []
    for name, (kind, v) in entities.items():
        numbers = [f"round({x}, 6) + CAST(0 AS DOUBLE)" for x in v] + ["CAST(NULL AS DOUBLE)"] * (6 - len(v))
        parts.append(f"SELECT point_id, '{name}' AS id, '{kind}' AS kind, {', '.join(f'{x} AS v{i + 1}' for i, x in enumerate(numbers))} FROM s")
    return f"WITH s AS ({_S}) " + " UNION ALL ".join(parts)


_N1, _N2, _N3 = ([f"CAST({c!r} AS DOUBLE)" for c in n] for n in _TURNED)


@_register(_entities_sql({
    "left": ("plane", [*_N1, "50 + a"]), "front": ("plane", [*_N2, "20 + b"]), "top": ("plane", [*_N3, "-100 - c"]), "left_in": ("plane", [*_N1, "a"]), "front_in": ("plane", [*_N2, "b"]),
    "axis": ("line", [*_along("-a", "-b", "0"), *_N3]), "target": ("point", _along("-a", "-b", "100 + c")), "corner": ("point", _along("-50 - a", "-20 - b", "100 + c")),
}))
def recipe_beam(spark, d):
    from .recipe import entity_table

    plan, table = _beam(spark, d)
    return entity_table(table, plan.recipe.kinds, "point_id")


_IN_FRAME = {
    "left": ("plane", ["1", "0", "0", "0"]), "front": ("plane", ["0", "1", "0", "0"]), "top": ("plane", ["0", "0", "1", "0"]), "left_in": ("plane", ["1", "0", "0", "-50"]), "front_in": ("plane", ["0", "1", "0", "-20"]),
    "axis": ("line", ["50", "20", "-100 - c", "0", "0", "1"]), "target": ("point", ["50", "20", "0"]), "corner": ("point", ["0", "0", "0"]),
}


@_register(_entities_sql(_IN_FRAME))
def aligned_export(spark, d):
    from .recipe import entity_table

    plan, table = _beam(spark, d)
    return entity_table(table, plan.recipe.kinds, "point_id", {name: plan.in_frame(name) for name in plan.recipe.kinds})


@_register(_entities_sql({k: _IN_FRAME[k] for k in ("axis", "target")}))
def geometry_summary(spark, d):
    """What is exported, seen from the frame."""
    from .recipe import entity_table

    plan, table = _beam(spark, d)
    names = {k: plan.recipe.kinds[k] for k in plan.recipe.doc["export"]}
    return entity_table(table, names, "point_id", {name: plan.in_frame(name) for name in names})


@_register(
    f"WITH s AS ({_S}) SELECT point_id, 'm1' AS id, round(sqrt(2900.0::DOUBLE), 6) AS value, 'mm' AS unit FROM s UNION ALL SELECT point_id, 'm2', 90.0::DOUBLE, 'deg' FROM s"
    " UNION ALL SELECT point_id, 'm3', round(sqrt(a*a + b*b + (100 + c)*(100 + c)), 6), 'mm' FROM s"
)
def recipe_measures(spark, d):
    from .recipe import MEASURES, Planner, Recipe, _pack

    doc = dict(_BEAM)
    # A circle's center at the origin of the survey, as one more face.
    doc["measures"] = [*_BEAM["measures"], {"id": "m3", "op": "distance_points", "a": "target", "b": "zero"}]
    doc["faces"] = {**_BEAM["faces"], "zero": {"from": "group", "name": "zero", "kind": "circle"}}
    _, table = _beam(spark, d)
    surveys = table.select("point_id", "left", "front", "top").withColumn("zero", _pack(Vec.of(0, 0, 0), "point"))
    plan = Planner(Recipe.of(doc), surveys)
    measures = plan.recipe.doc["measures"]
    rows = [F.struct(F.lit(m["id"]).alias("id"), (F.round(F.col(f"`measure:{m['id']}`"), 6) + 0.0).alias("value"), F.lit(MEASURES[m["op"]][1]).alias("unit")) for m in measures]
    return materialize(plan.run(), "beam").select("point_id", F.explode(F.array(*rows)).alias("m")).select("point_id", "m.*")


@_register(
    _ENTITY_SQL + f", k AS (SELECT *, {', '.join(f'{e} AS t{a}' for e, a in zip(S.cross(_na, _nb), 'xyz', strict=True))} FROM e),"
    f" h AS (SELECT *, {', '.join(f'{e} AS h{a}' for e, a in zip(S.mul(S.sub(S.mul(S.cross(S.vec('tx', 'ty', 'tz'), _nb), 'da'), S.mul(S.cross(S.vec('tx', 'ty', 'tz'), _na), 'db - 3')), '1 / ' + S.dot(S.vec('tx', 'ty', 'tz'), S.vec('tx', 'ty', 'tz'))), 'xyz', strict=True))} FROM k)"
    f" SELECT point_id, {S.out(S.norm(S.cross(S.sub(_q, S.vec('hx', 'hy', 'hz')), S.vec('tx', 'ty', 'tz'))) + ' / ' + S.norm(S.vec('tx', 'ty', 'tz')), 'value', 3)} FROM h"
)
def recipe_over_surveys(spark, d):
    """One recipe over a row a survey: offset, intersection and a distance in one projection."""
    from .recipe import Planner, Recipe, _pack

    doc = {
        "faces": {"a": {"name": "a"}, "b": {"name": "b"}, "p": {"name": "p", "kind": "circle"}},
        "construct": [{"id": "b2", "op": "offset", "plane": "b", "distance_mm": 3}, {"id": "ax", "op": "intersect_planes", "plane_a": "a", "plane_b": "b2"}],
        "measures": [{"id": "m", "op": "distance_point_line", "point": "p", "line": "ax"}],
    }
    e = _entities(spark, d)
    surveys = e.select("point_id", _pack(tuple(_A), "plane").alias("a"), _pack(tuple(_B), "plane").alias("b"), _pack(_QT, "point").alias("p"))
    return Planner(Recipe.of(doc), surveys).run().select("point_id", r6(F.col("`measure:m`"), "value", 3))


def _replay_sql(offset: str) -> str:
    tv = S.vec("tx", "ty", "tz")
    h = S.mul(S.sub(S.mul(S.cross(tv, _nb), "da"), S.mul(S.cross(tv, _na), f"db - {offset}")), f"1 / {S.dot(tv, tv)}")
    return (
        _ENTITY_SQL + f", k AS (SELECT *, {', '.join(f'{e} AS t{a}' for e, a in zip(S.cross(_na, _nb), 'xyz', strict=True))} FROM e),"
        f" h AS (SELECT *, {', '.join(f'{e} AS h{a}' for e, a in zip(h, 'xyz', strict=True))} FROM k)"
        f" SELECT point_id, {S.out(S.norm(S.cross(S.sub(_q, S.vec('hx', 'hy', 'hz')), tv)) + ' / ' + S.norm(tv), 'value', 3)}, {S.out(f'abs({S.dot(_na, _q)} + da)', 'kept', 3)} FROM h"
    )


@_register(_replay_sql("8"))
def recipe_replay(spark, d):
    """A session over a row a survey: one offset is changed, and its line and measure follow; the other measure is kept."""
    from .recipe import _pack
    from .replay import Session

    doc = {
        "faces": {"a": {"name": "a"}, "b": {"name": "b"}, "p": {"name": "p", "kind": "circle"}},
        "construct": [{"id": "b2", "op": "offset", "plane": "b", "distance_mm": 3}, {"id": "ax", "op": "intersect_planes", "plane_a": "a", "plane_b": "b2"}],
        "measures": [{"id": "m", "op": "distance_point_line", "point": "p", "line": "ax"}, {"id": "k", "op": "distance_point_plane", "point": "p", "plane": "a"}],
    }
    e = _entities(spark, d)
    surveys = e.select("point_id", _pack(tuple(_A), "plane").alias("a"), _pack(tuple(_B), "plane").alias("b"), _pack(_QT, "point").alias("p"))
    after = Session.start(doc, surveys).replace_step({"id": "b2", "op": "offset", "plane": "b", "distance_mm": 8})
    return after.table.select("point_id", r6(F.col("`measure:m`"), "value", 3), r6(F.col("`measure:k`"), "kept", 3))


@_register(
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'plane' ELSE 'of' END AS had, 'P' || p_size AS plane, CAST(p_retailprice AS DOUBLE) AS distance_mm FROM part"
)
def migrate_v1(spark, d):
    """Recipes of either version as JSON rows, brought to today's by the schema's own migration."""
    import json

    import pandas as pd

    from .schema import migrate_recipe

    part = spark.read.parquet(f"{d}/part.parquet")
    key = F.when(F.col("p_partkey") % 2 == 0, "plane").otherwise("of")
    step = F.create_map(key, F.concat(F.lit("P"), F.col("p_size").cast("string")), F.lit("distance_mm"), F.col("p_retailprice").cast("string"), F.lit("op"), F.lit("offset"))
    raw = part.select(F.col("p_partkey").alias("id"), key.alias("had"), F.to_json(step).alias("step"))

    def run(batches):
        for pdf in batches:
            docs = [migrate_recipe({"version": 1, "construct": [json.loads(s)]})["construct"][0] for s in pdf["step"]]
            yield pd.DataFrame({"id": pdf["id"], "had": pdf["had"], "plane": [s["plane"] for s in docs], "distance_mm": [float(s["distance_mm"]) for s in docs]})

    return raw.mapInPandas(run, "id long, had string, plane string, distance_mm double")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
