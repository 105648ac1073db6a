"""Named queries over the driver's tables, each with the same in SQL where SQL can say it.

Images are made by formula, one per supplier row, so that they grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave import pixels as P
from pixelweave.operators import align, features, filters, focus, kernels, measure, population, resample, table, texture
from pixelweave.plans.plan import Phase, Plan, Step
from pixelweave.streaming import scopes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
H, W = P.HEIGHT, P.WIDTH
PIX = "WITH " + P.SQL_GRID
STACK = "WITH " + P.SQL_STACK


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark, sf_dir):
    return P.scene(P.suppliers(spark, sf_dir), "s_suppkey")


def masks(spark, sf_dir):
    return P.scene_masks(P.suppliers(spark, sf_dir), "s_suppkey")


def px(spark, sf_dir):
    return measure.of_objects(pixels(spark, sf_dir), masks(spark, sf_dir))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles that depend on the order of sums, rounded; adding 0 makes -0 plain."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def r6(sql: str, name: str | None = None) -> str:
    return f"round({sql}, 6) + 0.0" + (f" AS {name}" if name else "")


# ---- scans and projections


def stacks(spark, sf_dir):
    return P.stack(P.suppliers(spark, sf_dir), "s_suppkey")


@query(STACK + "SELECT image_id, r, c, v FROM stack WHERE ch = 1 AND z = 2")
def plane_select(spark, sf_dir):
    return P.select_plane(stacks(spark, sf_dir), t=0, ch=1, z=2)


@query(STACK + "SELECT image_id, r, c, v FROM stack WHERE ch = 1 AND z = 2")
def z_mid(spark, sf_dir):
    return P.select_plane(stacks(spark, sf_dir), t=0, ch=-1, z="mid")


@query(STACK + "SELECT image_id, r, c, max(v) AS v FROM stack WHERE ch = 0 GROUP BY ALL")
def z_max_projection(spark, sf_dir):
    return P.select_plane(stacks(spark, sf_dir), ch=0, z="max")


@query(STACK + "SELECT image_id, r, c, round_even(avg(v), 0) AS v FROM stack WHERE ch = 0 GROUP BY image_id, r, c")
def z_mean_projection(spark, sf_dir):
    return P.select_plane(stacks(spark, sf_dir), ch=0, z="mean")


@query("SELECT l_orderkey AS image_id, idx FROM (SELECT l_orderkey, l_linenumber AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN lower(l_returnflag) = 'n' THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE lower(l_returnflag) = 'n' OR CAST(l_linenumber AS VARCHAR) = 'n') WHERE n = 1")
def channel_resolve_by_name(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("name"))
    return P.resolve_channel(lines, "N")


@query("SELECT c_custkey AS image_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'nm' WHEN 'AUTOMOBILE' THEN 'mm' WHEN 'MACHINERY' THEN 'µm' ELSE 'parsec' END AS unit, round(c_acctbal * CASE c_mktsegment WHEN 'BUILDING' THEN 1e-9 / 1e-6 WHEN 'AUTOMOBILE' THEN 1e-3 / 1e-6 WHEN 'MACHINERY' THEN 1.0 END, 6) AS um FROM customer")
def unit_convert(spark, sf_dir):
    unit = F.when(F.col("c_mktsegment") == "BUILDING", "nm").when(F.col("c_mktsegment") == "AUTOMOBILE", "mm").when(F.col("c_mktsegment") == "MACHINERY", "µm").otherwise("parsec")
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), unit.alias("unit"), "c_acctbal")
    return rows.select("image_id", "unit", F.round(P.in_micrometres(F.col("c_acctbal"), F.col("unit")), 6).alias("um"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def content_digest(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query(STACK + "SELECT image_id, r, c, ch, v FROM stack WHERE z = 0 UNION ALL SELECT image_id, r, c, ch + 2, v FROM stack WHERE z = 1 AND ch = 0")
def extra_channels_union(spark, sf_dir):
    rows = stacks(spark, sf_dir)
    cols = ("image_id", "r", "c", "ch", "v")
    return P.extra_channels(rows.where("z = 0").select(*cols), rows.where("z = 1 and ch = 0").select(*cols))


# ---- filters

_SIZES = ", sizes AS (SELECT image_id, label, count(*) AS n FROM masks GROUP BY ALL)"


@query(PIX + _SIZES + "SELECT m.image_id, m.r, m.c, m.label FROM masks m JOIN sizes s USING (image_id, label) WHERE s.n BETWEEN 13 AND 49")
def area_filter(spark, sf_dir):
    own = masks(spark, sf_dir)
    low, high = filters.area_bounds(1.0, min_area=12.3, max_diameter=8.0)
    assert (low, high) == (13, 50)
    return filters.keep_labels(own, filters.by_area(own, low, 49)).select("image_id", "r", "c", "label")


@query(PIX + f", clear AS (SELECT image_id, label FROM masks GROUP BY ALL HAVING min(r) >= 2 AND max(r) <= {H - 3} AND min(c) >= 2 AND max(c) <= {W - 3}) SELECT image_id, r, c, label FROM masks JOIN clear USING (image_id, label)")
def border_filter(spark, sf_dir):
    own = masks(spark, sf_dir)
    return filters.keep_labels(own, filters.by_border(own, 2, H, W)).select("image_id", "r", "c", "label")


@query(PIX + ", k AS (SELECT DISTINCT image_id, label FROM masks WHERE label % 3 = 1) SELECT image_id, list_sort(list(DISTINCT label)) AS labels FROM masks ANTI JOIN k USING (image_id, label) GROUP BY image_id")
def dropped_labels(spark, sf_dir):
    own = masks(spark, sf_dir)
    return filters.dropped(own, own.where("label % 3 = 1"))


@query("SELECT p_partkey, CAST(ceil(pi() * (p_size / 2.0) * (p_size / 2.0) / (p_retailprice / 100)) AS BIGINT) AS low_px, CAST(floor(pi() * (p_size / 2.0) * (p_size / 2.0) / (p_retailprice / 100)) AS BIGINT) AS high_px FROM part")
def size_bounds_from_diameter(spark, sf_dir):
    d, a = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    return load(spark, sf_dir, "part").select("p_partkey", filters.area_bound_px(d, a, False).alias("low_px"), filters.area_bound_px(d, a, True).alias("high_px"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'default' END AS setting FROM orders")
def setting_precedence(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    given = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("k"), none)).otherwise(empty)
    params = F.when(F.col("o_orderstatus").isin("F", "P"), F.create_map(F.lit("k"), F.col("o_orderpriority"))).otherwise(empty)
    return orders.select("o_orderkey", filters.setting(given, params, "k", F.lit("default")).alias("setting"))


_CANDIDATES = {"l_discount": "l_discount", "l_extendedprice": "l_extendedprice", "l_linenumber": "l_linenumber", "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_quantity": "l_quantity", "l_suppkey": "l_suppkey", "l_tax": "l_tax", "even": "3.0", "rare": "CASE WHEN l_orderkey % 5 = 0 THEN l_tax END"}


# numbers that are finite in half the rows at least and vary; places, by name or by how a name begins, are none
@query(" UNION ALL ".join(f"SELECT '{n}' AS feature FROM lineitem HAVING count({x}) >= 0.5 * count(*) AND max({x}) > min({x})" for n, x in _CANDIDATES.items()))
def feature_selection(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("even", F.lit(3.0)).withColumn("rare", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_tax")))
    lines = lines.withColumns({n: F.col("l_tax") for n in ("intensity", "bbox_min_row_px", "weighted_centroid_r", "stage_x_um", "bg_global_mean_c1")})
    return spark.createDataFrame([(n,) for n in population.measured_columns(lines)], "feature string")


# ---- joins


@query(PIX + "SELECT image_id, count(*) AS n, " + r6("sum(v)", "total") + " FROM pixels ANTI JOIN masks USING (image_id, r, c) GROUP BY image_id")
def background_anti(spark, sf_dir):
    own = pixels(spark, sf_dir).join(masks(spark, sf_dir), ["image_id", "r", "c"], "left_anti")
    return own.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("v"), 6) + 0.0).alias("total"))


_OBJECTS = ", o AS (SELECT image_id, label, avg(r) AS y, avg(c) AS x FROM masks GROUP BY ALL)"


@query("WITH p AS (SELECT c_custkey AS id, c_acctbal / 10 AS x, CAST(c_custkey % 997 AS DOUBLE) AS y FROM customer) SELECT a.id, count(b.id) AS neighbours FROM p a LEFT JOIN p b ON a.id <> b.id AND b.x BETWEEN a.x - 5 AND a.x + 5 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25 GROUP BY a.id")
def neighbours_within_radius(spark, sf_dir):
    points = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 997).cast("double").alias("y"))
    return measure.within(points, 5.0)


@query(PIX + _OBJECTS + ", p AS (SELECT a.image_id, a.label, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d, b.label AS other FROM o a JOIN o b ON a.image_id = b.image_id AND a.label <> b.label), q AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY d, other) AS n FROM p) SELECT o.image_id, o.label, " + r6("min(d)", "nn_distance") + ", " + r6("avg(d)", "nn5_mean_distance") + " FROM o LEFT JOIN q ON o.image_id = q.image_id AND o.label = q.label AND q.n <= 5 GROUP BY o.image_id, o.label")
def k_nearest(spark, sf_dir):
    return rounded(measure.nearest(measure.base(px(spark, sf_dir))), "nn_distance", "nn5_mean_distance")


@query(PIX + f"SELECT a.image_id, {r6('corr(a.v, b.v)', 'agreement')} FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND a.r = b.r + 3 AND a.c = b.c + 2 GROUP BY a.image_id")
def overlap_agreement(spark, sf_dir):
    own = pixels(spark, sf_dir)
    moved = own.select("image_id", (F.col("r") + 3).alias("r"), (F.col("c") + 2).alias("c"), F.col("v").alias("w"))
    return rounded(own.join(moved, ["image_id", "r", "c"]).groupBy("image_id").agg(F.corr("v", "w").alias("agreement")), "agreement")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def population_ids_semi(spark, sf_dir):
    ids = load(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, sf_dir, "part").join(ids, "p_partkey", "left_semi").select("p_partkey", "p_name", "p_retailprice")


# ---- aggregates

_RATIO = "CASE WHEN sum(v) <> 0 THEN sum(v * {0}) / sum(v) END"


@query(PIX + f"""SELECT image_id, label, count(*) AS area, min(r) AS bbox_r0, min(c) AS bbox_c0, max(r) + 1 AS bbox_r1, max(c) + 1 AS bbox_c1,
  {r6('avg(r)', 'centroid_r')}, {r6('avg(c)', 'centroid_c')}, {r6(_RATIO.format('r'), 'weighted_r')}, {r6(_RATIO.format('c'), 'weighted_c')},
  {r6('avg(v)', 'mean')}, min(v) AS least, max(v) AS greatest, {r6('stddev_pop(v)', 'spread')}, median(v) AS median,
  {r6('sqrt(4 * count(*) / pi())', 'equivalent_diameter')}, {r6('count(*) / ((max(r) - min(r) + 1) * (max(c) - min(c) + 1))', 'extent')} FROM px GROUP BY ALL""")
def object_measures(spark, sf_dir):
    return rounded(measure.base(px(spark, sf_dir)), "centroid_r", "centroid_c", "weighted_r", "weighted_c", "mean", "spread", "equivalent_diameter", "extent")


@query(PIX + f""", m AS (SELECT image_id, label, count(*) AS n, var_pop(c) AS a, -covar_pop(r, c) AS b, var_pop(r) AS d FROM masks GROUP BY ALL),
  e AS (SELECT *, (a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS l1, greatest(0, (a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2) AS l2 FROM m)
  SELECT image_id, label, round(4 * sqrt(l1), 4) + 0.0 AS major_axis, round(4 * sqrt(l2), 4) + 0.0 AS minor_axis FROM e""")
def object_axes(spark, sf_dir):
    return rounded(measure.axes(masks(spark, sf_dir)).select("image_id", "label", "major_axis", "minor_axis"), "major_axis", "minor_axis", digits=4)


_NEAR = "EXISTS (SELECT 1 FROM masks q WHERE q.image_id = m.image_id AND q.label = m.label AND q.r = m.r + {0} AND q.c = m.c + {1})"


def _join(alias: str, dr: int, dc: int, left: str = "m") -> str:
    return f"LEFT JOIN masks {alias} ON {alias}.image_id = {left}.image_id AND {alias}.label = {left}.label AND {alias}.r = {left}.r + {dr} AND {alias}.c = {left}.c + {dc}"


@query(PIX + f""", n AS (SELECT m.image_id, m.label, m.r, m.c, (a.r IS NOT NULL) AND (b.r IS NOT NULL) AND (x.r IS NOT NULL) AND (y.r IS NOT NULL) AS inner_ FROM masks m
  {_join('a', 0, 1)} {_join('b', 0, -1)} {_join('x', 1, 0)} {_join('y', -1, 0)}),
  bd AS (SELECT image_id, label, r, c FROM n WHERE NOT inner_),
  code AS (SELECT m.image_id, m.label, m.r, m.c, 1 + coalesce(sum(CASE WHEN q.r IS NULL THEN 0 WHEN q.r = m.r OR q.c = m.c THEN 2 ELSE 10 END), 0) AS x FROM bd m
    LEFT JOIN bd q ON q.image_id = m.image_id AND q.label = m.label AND q.r BETWEEN m.r - 1 AND m.r + 1 AND q.c BETWEEN m.c - 1 AND m.c + 1 AND NOT (q.r = m.r AND q.c = m.c) GROUP BY ALL)
  SELECT image_id, label, {r6("sum(CASE WHEN x IN (5, 7, 15, 17, 25, 27) THEN 1.0 WHEN x IN (21, 33) THEN sqrt(2.0) WHEN x IN (13, 23) THEN (1 + sqrt(2.0)) / 2 ELSE 0.0 END)", 'perimeter')} FROM code GROUP BY ALL""")
def object_perimeter(spark, sf_dir):
    return rounded(measure.perimeter(masks(spark, sf_dir)), "perimeter")


@query(PIX + f"""SELECT m.image_id, m.label, {r6("pi() / 4 * (2 * count(*) - count(a.r) - count(b.r) + sqrt(0.5) * (2 * count(*) - count(x.r) - count(y.r)))", 'perimeter_crofton')}
  FROM masks m {_join('a', 0, 1)} {_join('b', 1, 0)} {_join('x', 1, 1)} {_join('y', 1, -1)} GROUP BY m.image_id, m.label""")
def object_crofton(spark, sf_dir):
    return rounded(measure.crofton(masks(spark, sf_dir)), "perimeter_crofton")


@query(PIX + "SELECT p.image_id, " + r6("avg(p.v) FILTER (m.label IS NULL)", "bg_global_mean") + " FROM pixels p LEFT JOIN masks m USING (image_id, r, c) GROUP BY p.image_id")
def global_background(spark, sf_dir):
    return rounded(measure.global_background(pixels(spark, sf_dir), masks(spark, sf_dir)), "bg_global_mean")


@query(PIX + ", k AS (SELECT DISTINCT m.image_id, m.label, CAST(m.r + a.i AS INTEGER) AS r, CAST(m.c + b.j AS INTEGER) AS c FROM masks m, range(-3, 4) a(i), range(-3, 4) b(j) WHERE a.i * a.i + b.j * b.j <= 9) SELECT k.image_id, k.label, " + r6("avg(p.v)", "bg_local_mean") + " FROM k JOIN pixels p USING (image_id, r, c) ANTI JOIN masks m USING (image_id, r, c) GROUP BY ALL")
def local_background(spark, sf_dir):
    return rounded(measure.local_background(pixels(spark, sf_dir), masks(spark, sf_dir), 3), "bg_local_mean")


def _n(dr: int, dc: int) -> str:
    return f"n{'mzp'[dr + 1]}{'mzp'[dc + 1]}"


_ROW = ", s1 AS (SELECT *, coalesce(lag(v) OVER w, v) AS hm, v AS hz, coalesce(lead(v) OVER w, v) AS hp FROM pixels WINDOW w AS (PARTITION BY image_id, r ORDER BY c))"
_STENCIL = _ROW + ", s AS (SELECT image_id, r, c, v, " + ", ".join(f"coalesce({f}(h{e}) OVER w, h{e}) AS n{d}{e}v" if f else f"h{e} AS nz{e}v" for d, f in (("m", "lag"), ("z", ""), ("p", "lead")) for e in "mzp") + " FROM s1 WINDOW w AS (PARTITION BY image_id, c ORDER BY r))"


def _v(*terms: tuple[int, int, int]) -> str:
    return " ".join(f"{'+' if s > 0 else '-'} {_n(d, e)}v" for s, d, e in terms)


_DOWN = _v((1, 1, -1), (1, 1, 0), (1, 1, 1), (-1, -1, -1), (-1, -1, 0), (-1, -1, 1))
_RIGHT = _v((1, -1, 1), (1, 0, 1), (1, 1, 1), (-1, -1, -1), (-1, 0, -1), (-1, 1, -1))


@query(PIX + _STENCIL + f"SELECT m.image_id, m.label, {r6(f'avg(sqrt((pow(({_DOWN}) / 6, 2) + pow(({_RIGHT}) / 6, 2)) / 2))', 'prewitt_magnitude_mean')} FROM masks m JOIN s USING (image_id, r, c) GROUP BY ALL")
def gradient_prewitt(spark, sf_dir):
    found = texture.mean_of(texture.prewitt(pixels(spark, sf_dir), H, W), masks(spark, sf_dir), "prewitt")
    return rounded(found, "prewitt_magnitude_mean")


@query(PIX + _STENCIL + f"SELECT m.image_id, m.label, {r6('avg(sqrt((pow(v - nmmv, 2) + pow(nzmv - nmzv, 2)) / 2))', 'roberts_magnitude_mean')} FROM masks m JOIN s USING (image_id, r, c) GROUP BY ALL")
def gradient_roberts(spark, sf_dir):
    found = texture.mean_of(texture.roberts(pixels(spark, sf_dir), H, W), masks(spark, sf_dir), "roberts")
    return rounded(found, "roberts_magnitude_mean")


_SCALE = ", sc AS (SELECT p.image_id, coalesce(quantile_cont(CASE WHEN m.label IS NOT NULL THEN p.v END, 0.999), quantile_cont(p.v, 0.999)) AS q FROM pixels p LEFT JOIN masks m USING (image_id, r, c) GROUP BY p.image_id), scales AS (SELECT image_id, CASE WHEN q > 0 THEN q ELSE 1.0 END AS scale FROM sc)"


@query(PIX + _SCALE + "SELECT image_id, round(scale, 6) AS scale FROM scales")
def texture_scale(spark, sf_dir):
    return texture.scale(pixels(spark, sf_dir), masks(spark, sf_dir)).select("image_id", F.round("scale", 6).alias("scale"))


# moments of whole numbers from exact sums of their powers
_MOMENTS = """su AS (SELECT image_id, label, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST({1} AS BIGINT)) AS DOUBLE) AS s1, CAST(sum(CAST({1} AS BIGINT) ** 2) AS DOUBLE) AS s2, CAST(sum(CAST({1} AS BIGINT) ** 3) AS DOUBLE) AS s3, CAST(sum(CAST({1} AS BIGINT) ** 4) AS DOUBLE) AS s4 FROM {0} GROUP BY ALL),
  av AS (SELECT image_id, label, s1 / n AS a, s2 / n AS b2, s3 / n AS b3, s4 / n AS b4 FROM su),
  mo AS (SELECT image_id, label, b2 - a * a AS m2, b3 - 3 * a * b2 + 2 * a * a * a AS m3, b4 - 4 * a * b3 + 6 * a * a * b2 - 3 * a * a * a * a AS m4 FROM av)"""
_SKEW = "round(CASE WHEN m2 > 1e-9 THEN m3 / (m2 * sqrt(m2)) END, 6) + 0.0 AS {0}_skewness, round(CASE WHEN m2 > 1e-9 THEN m4 / (m2 * m2) - 3 END, 6) + 0.0 AS {0}_kurtosis"
_LEVELS = ", lv AS (SELECT image_id, label, r, c, CAST(floor(greatest(0.0, least({0}.0, v / scale * {0}.0))) AS INTEGER) AS q FROM px JOIN scales USING (image_id))"


@query(PIX + _SCALE + _LEVELS.format(255) + f""", k AS (SELECT image_id, label, q, count(*) AS k FROM lv GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY image_id, label) AS p FROM k),
  hi AS (SELECT image_id, label, sum(k * k) / (sum(k) * sum(k)) AS u, greatest(0.0, -sum(p * log2(p))) AS e FROM p GROUP BY ALL),
{_MOMENTS.format('lv', 'q')}
  SELECT image_id, label, u AS intensity_uniformity, {r6('e', 'intensity_entropy')}, {_SKEW.format('intensity')} FROM hi JOIN mo USING (image_id, label)""")
def histogram_texture(spark, sf_dir):
    own = pixels(spark, sf_dir)
    found = texture.histogram(px(spark, sf_dir), texture.scale(own, masks(spark, sf_dir)))
    return rounded(found, "intensity_entropy", "intensity_skewness", "intensity_kurtosis")


@query(PIX + _SCALE + _LEVELS.format(15) + """, w AS (SELECT image_id, label, q + 1 AS g, unnest([{'way': 0, 'line': r, 'place': c}, {'way': 1, 'line': c, 'place': r}, {'way': 2, 'line': r - c, 'place': r}, {'way': 3, 'line': r + c, 'place': r}]) AS s FROM lv),
  i AS (SELECT image_id, label, g, s.way AS way, s.line AS line, s.place - row_number() OVER (PARTITION BY image_id, label, s.way, s.line, g ORDER BY s.place) AS island FROM w),
  runs AS (SELECT image_id, label, g, way, line, island, count(*) AS length FROM i GROUP BY ALL),
  n AS (SELECT image_id, label, count(*) AS n, sum(1.0 / (g * g)) / count(*) AS lo, sum(CAST(g * g AS DOUBLE)) / count(*) AS hi FROM runs GROUP BY ALL),
  a AS (SELECT image_id, label, sum(k * k) AS a FROM (SELECT image_id, label, length, count(*) AS k FROM runs GROUP BY ALL) GROUP BY ALL),
  b AS (SELECT image_id, label, sum(k * k) AS b FROM (SELECT image_id, label, g, count(*) AS k FROM runs GROUP BY ALL) GROUP BY ALL)
  SELECT image_id, label, """ + f"{r6('a / n', 'glrlm_rlnu')}, {r6('lo', 'glrlm_lglre')}, {r6('hi', 'glrlm_hglre')}, {r6('b / n', 'glrlm_glnu')} FROM n JOIN a USING (image_id, label) JOIN b USING (image_id, label)")
def glrlm(spark, sf_dir):
    found = texture.run_length_features(texture.runs(px(spark, sf_dir), texture.scale(pixels(spark, sf_dir), masks(spark, sf_dir))))
    return rounded(found, "glrlm_rlnu", "glrlm_lglre", "glrlm_hglre", "glrlm_glnu")


@query(PIX + f""", m AS (SELECT image_id, label, avg(r) AS y, avg(c) AS x FROM px GROUP BY ALL), dd AS (SELECT px.*, pow(px.r - y, 2) + pow(px.c - x, 2) AS d2 FROM px JOIN m USING (image_id, label)),
  s AS (SELECT image_id, label, avg(d2) AS g, sum(v * d2) AS s, avg(v) AS m, count(*) AS n FROM dd GROUP BY ALL)
  SELECT image_id, label, {r6('sqrt(g)', 'radius_of_gyration')}, {r6('CASE WHEN g > 0 AND m > 0 THEN s / (m * n * g) END', 'intensity_radial_variance')} FROM s""")
def radius_of_gyration(spark, sf_dir):
    return rounded(measure.gyration(px(spark, sf_dir)), "radius_of_gyration", "intensity_radial_variance")


_RING = "[" + ", ".join(f"{{'bit': {1 << i}, 'y': {d}, 'x': {e}}}" for i, (d, e) in enumerate([(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)])) + "]"


# a pixel of eight bits against eight places on a circle around it: those on diagonals lie between four pixels, beyond the image all is 0
@query(PIX + _SCALE + f""", b8 AS (SELECT image_id, r, c, CAST(floor(greatest(0.0, least(255.0, v / scale * 255.0))) AS BIGINT) AS v FROM pixels JOIN scales USING (image_id)),
  pl AS (SELECT image_id, r, c, v, unnest({_RING}) AS o FROM b8),
  nb AS (SELECT pl.image_id, pl.r, pl.c, pl.v, o.bit AS bit, o.y <> 0 AND o.x <> 0 AS corner, coalesce(n.v, 0) AS n, coalesce(y.v, 0) AS y, coalesce(x.v, 0) AS x FROM pl
    LEFT JOIN b8 n ON n.image_id = pl.image_id AND n.r = pl.r + o.y AND n.c = pl.c + o.x LEFT JOIN b8 y ON y.image_id = pl.image_id AND y.r = pl.r + o.y AND y.c = pl.c LEFT JOIN b8 x ON x.image_id = pl.image_id AND x.r = pl.r AND x.c = pl.c + o.x),
  pt AS (SELECT image_id, r, c, CAST(sum(CASE WHEN round(CASE WHEN corner THEN v * 0.0857910841 + (y + x) * 0.2071089159 + n * 0.4999910841 ELSE n END - v, 6) >= 0 THEN bit ELSE 0 END) AS INTEGER) AS q FROM nb GROUP BY ALL),
  lb AS (SELECT image_id, label, q FROM masks JOIN pt USING (image_id, r, c)), k AS (SELECT image_id, label, q, count(*) AS k FROM lb GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY image_id, label) AS p FROM k),
  hi AS (SELECT image_id, label, sum(k * k) / (sum(k) * sum(k)) AS u, greatest(0.0, -sum(p * log2(p))) AS e FROM p GROUP BY ALL), mean AS (SELECT image_id, label, avg(q) AS q, stddev_pop(q) AS s FROM lb GROUP BY ALL),
  {_MOMENTS.format('lb', 'q')}
  SELECT image_id, label, {r6('q', 'lbp_mean')}, {r6('s', 'lbp_std')}, u AS lbp_energy, {r6('e', 'lbp_entropy')}, {_SKEW.format('lbp')} FROM hi JOIN mo USING (image_id, label) JOIN mean USING (image_id, label)""")
def lbp_stats(spark, sf_dir):
    own = pixels(spark, sf_dir)
    eight = texture.eight_bit(own, texture.scale(own, masks(spark, sf_dir)))
    found = texture.lbp_stats(texture.binary_patterns(eight, H, W), masks(spark, sf_dir))
    return rounded(found, *[f"lbp_{n}" for n in "mean std entropy skewness kurtosis".split()])


@query(STACK + ", m AS (SELECT image_id, r, c, CAST(r // 4 + 1 AS INTEGER) AS label FROM stack WHERE ch = 0 AND z = 0 AND c < 9) SELECT m.image_id, m.label, " + ", ".join(
    f"{r6('avg(s.v) FILTER (s.ch = {i})', f'mean_c{i}')}, min(s.v) FILTER (s.ch = {i}) AS least_c{i}, max(s.v) FILTER (s.ch = {i}) AS greatest_c{i}, {r6('stddev_pop(s.v) FILTER (s.ch = {i})', f'spread_c{i}')}, median(s.v) FILTER (s.ch = {i}) AS median_c{i}, {r6('sum(s.v) FILTER (s.ch = {i})', f'total_c{i}')}".replace("{i}", str(i)) for i in (0, 1)
) + " FROM m JOIN stack s USING (image_id, r, c) WHERE s.z = 0 GROUP BY ALL")
def channel_means(spark, sf_dir):
    own = stacks(spark, sf_dir).where("z = 0")
    labels = own.where("ch = 0 and c < 9").select("image_id", "r", "c", (F.floor(F.col("r") / 4) + 1).cast("int").alias("label"))
    found = measure.by_channel(labels.join(own.select("image_id", "r", "c", "ch", "v"), ["image_id", "r", "c"]), [0, 1])
    return rounded(found, *[f"{n}_c{i}" for i in (0, 1) for n in ("mean", "spread", "total")])


# ---- focus

_PL = STACK + ", planes AS (SELECT image_id AS stack_id, z, r, c, v FROM stack WHERE ch = 0)"


def planes(spark, sf_dir):
    return stacks(spark, sf_dir).where("ch = 0").select(F.col("image_id").alias("stack_id"), "z", "r", "c", "v")


_AHEAD = ", ah AS (SELECT *, lead(v, 1) OVER a AS x1, lead(v, 2) OVER a AS x2, lead(v, 1) OVER b AS y1, lead(v, 2) OVER b AS y2 FROM planes WINDOW a AS (PARTITION BY stack_id, z, r ORDER BY c), b AS (PARTITION BY stack_id, z, c ORDER BY r))"
_BR = _PL + _AHEAD + ", br AS (SELECT stack_id, z, avg(pow(x2 - v, 2)) + avg(pow(y2 - v, 2)) AS s FROM ah GROUP BY ALL)"


@query(_BR + f"SELECT stack_id, z, {r6('s', 'brenner')} FROM br")
def brenner(spark, sf_dir):
    return rounded(focus.brenner(planes(spark, sf_dir)), "brenner")


@query(_PL + _AHEAD + f"SELECT stack_id, z, {r6('avg(CASE WHEN x2 IS NOT NULL THEN v * x1 - v * x2 END) + avg(CASE WHEN y2 IS NOT NULL THEN v * y1 - v * y2 END)', 'vollath_f4')} FROM ah GROUP BY ALL")
def vollath_f4(spark, sf_dir):
    return rounded(focus.vollath(planes(spark, sf_dir)), "vollath_f4")


@query(_PL + f", e AS (SELECT stack_id, z, quantile_cont(v, 0.9) AS edge FROM planes GROUP BY ALL) SELECT stack_id, z, {r6('avg(v)', 'intensity')} FROM planes JOIN e USING (stack_id, z) WHERE v >= edge GROUP BY ALL")
def intensity_focus(spark, sf_dir):
    return rounded(focus.bright(planes(spark, sf_dir), 90.0), "intensity")


@query(_BR + f""", l AS (SELECT *, round(s, 6) AS q FROM br), i AS (SELECT stack_id, q AS s, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY stack_id) AS n, lag(q) OVER w AS a, lead(q) OVER w AS b FROM l WINDOW w AS (PARTITION BY stack_id ORDER BY z)),
  k AS (SELECT *, least(1, greatest(0, (n - 1) // 2)) AS skip FROM i), t AS (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY s DESC, i) AS rk FROM k WHERE i >= skip AND i < n - skip),
  f AS (SELECT *, a > 0 AND s > 0 AND b > 0 AS logs FROM t WHERE rk = 1),
  g AS (SELECT *, CASE WHEN logs THEN ln(a) ELSE a END AS la, CASE WHEN logs THEN ln(s) ELSE s END AS ls, CASE WHEN logs THEN ln(b) ELSE b END AS lb FROM f),
  h AS (SELECT stack_id, i AS best, coalesce(a < s AND b < s, false) AS found, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND la - 2 * ls + lb < 0 THEN i + 0.5 * (la - lb) / (la - 2 * ls + lb) ELSE i END AS refined FROM g)
  SELECT stack_id, CAST(best AS INTEGER) AS best, found, round(refined, 4) + 0.0 AS refined, CASE WHEN found THEN round(100 + 2 * least(greatest(refined, 0), 4), 4) + 0.0 END AS z_um FROM h""")
def focus_peak(spark, sf_dir):
    own = planes(spark, sf_dir)
    heights = own.select("stack_id", "z").distinct().withColumn("z_um", 100.0 + 2.0 * F.col("z"))
    return rounded(focus.peak(rounded(focus.brenner(own), "brenner"), "brenner", 1, heights), "refined", "z_um", digits=4)


# an orthonormal cosine transform as two sums over its basis, rows 12 and columns 14 of a plane
_BASIS = "{0} AS (SELECT k, i, sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / {1}.0) * cos(pi() * (2 * i + 1) * k / {2}.0) AS w FROM range({1}) a(k), range({1}) b(i))"
_DCT = f""", {_BASIS.format('bx', 14, 28)}, {_BASIS.format('by_', 12, 24)}, t1 AS (SELECT stack_id, z, r, k AS kx, sum(v * w) AS t FROM planes JOIN bx ON bx.i = planes.c GROUP BY ALL),
  t2 AS (SELECT stack_id, z, kx, k AS ky, pow(sum(t * w), 2) AS e FROM t1 JOIN by_ ON by_.i = t1.r GROUP BY ALL), t3 AS (SELECT stack_id, z, e / sum(e) OVER (PARTITION BY stack_id, z) AS p FROM t2 WHERE kx > 0 OR ky > 0),
  dct AS (SELECT stack_id, z, coalesce(-sum(p * log2(p)) FILTER (p > 0), 0) AS s FROM t3 GROUP BY ALL)"""


@query(_PL + _DCT + f"SELECT stack_id, z, {r6('s', 'dct_entropy')} FROM dct")
def dct_entropy(spark, sf_dir):
    return rounded(focus.dct_entropy(planes(spark, sf_dir), 12, 14), "dct_entropy")


@query(_BR + _DCT + f""", vo AS (SELECT stack_id, z, avg(CASE WHEN x2 IS NOT NULL THEN v * x1 - v * x2 END) + avg(CASE WHEN y2 IS NOT NULL THEN v * y1 - v * y2 END) AS s FROM ah GROUP BY ALL),
  ed AS (SELECT stack_id, z, quantile_cont(v, 0.99) AS edge FROM planes GROUP BY ALL), it AS (SELECT stack_id, z, avg(v) AS s FROM planes JOIN ed USING (stack_id, z) WHERE v >= edge GROUP BY ALL),
  al AS (SELECT *, 'brenner' AS measure FROM br UNION ALL SELECT *, 'vollath_f4' FROM vo UNION ALL SELECT *, 'intensity' FROM it UNION ALL SELECT *, 'dct_entropy' FROM dct)
  SELECT stack_id, z, measure, {r6('s', 'score')} FROM al""")
def focus_curves(spark, sf_dir):
    return rounded(focus.curves(planes(spark, sf_dir), 12, 14), "score")


# ---- windows and sets


@query(PIX + "SELECT DISTINCT image_id, label, dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS fresh FROM masks")
def relabel_sequential(spark, sf_dir):
    labels = masks(spark, sf_dir).select("image_id", "label").distinct()
    return labels.withColumn("fresh", F.dense_rank().over(Window.partitionBy("image_id").orderBy("label")).cast("long"))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events")
def priority_order(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long").alias("turn"))


@query(PIX + f", bo AS (SELECT DISTINCT image_id, label FROM masks WHERE r < 2 OR r >= {H - 2} OR c < 2 OR c >= {W - 2}), sm AS (SELECT image_id, label FROM masks GROUP BY ALL HAVING count(*) < 20) SELECT image_id, label FROM bo UNION SELECT image_id, label FROM sm")
def dropped_union(spark, sf_dir):
    own = masks(spark, sf_dir)
    every = own.select("image_id", "label").distinct()
    keys = ["image_id", "label"]
    return every.join(filters.by_border(own, 2, H, W), keys, "left_anti").union(every.join(filters.by_area(own, 20), keys, "left_anti")).distinct()


# ---- scalars


@query(PIX + f""", o AS (SELECT image_id, label, count(*) AS area, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY ALL),
  k AS (SELECT m.image_id, m.label, pi() / 4 * (2 * count(*) - count(a.r) - count(b.r) + sqrt(0.5) * (2 * count(*) - count(x.r) - count(y.r))) AS p FROM masks m {_join('a', 0, 1)} {_join('b', 1, 0)} {_join('x', 1, 1)} {_join('y', 1, -1)} GROUP BY m.image_id, m.label)
  SELECT image_id, label, {r6('CASE WHEN p > 0 THEN 4 * pi() * area / (p * p) END', 'circularity')}, {r6('m * area', 'intensity_total')}, {r6('CASE WHEN m > 0 THEN s / m END', 'intensity_cv')} FROM o JOIN k USING (image_id, label)""")
def derived_ratios(spark, sf_dir):
    objects = measure.base(px(spark, sf_dir)).join(measure.crofton(masks(spark, sf_dir)), ["image_id", "label"])
    return rounded(measure.derived(objects).select("image_id", "label", "circularity", "intensity_total", "intensity_cv"), "circularity", "intensity_total", "intensity_cv")


@query("SELECT part.p_partkey, CASE WHEN length(s) > 0 THEN s ELSE 'item' END AS slug FROM part JOIN (SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part) t ON t.p_partkey = part.p_partkey")
def slugs(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", table.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, 'R' || (l_suppkey % 4) || '_r' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 3, '0') || '_c' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || '_obj' || lpad(CAST(l_linenumber AS VARCHAR), 5, '0') AS id FROM lineitem")
def object_names(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    parts = F.array(F.concat(F.lit("R"), (F.col("l_suppkey") % 4).cast("string")), (F.col("l_suppkey") % 100).cast("string"), (F.col("l_partkey") % 1000).cast("string"))
    return lines.select("l_orderkey", "l_linenumber", table.object_id(table.tile_name(parts), F.col("l_linenumber")).alias("id"))


@query("SELECT o_orderkey, round(o_totalprice + 0.0 * ((o_custkey % 48) - 24.0) * 2 - 1.0 * ((o_orderkey % 40) - 20.0) * 3, 6) AS x_um, CAST(1.0 * ((o_custkey % 48) - 24.0) * 2 + 0.0 * ((o_orderkey % 40) - 20.0) * 3 AS DOUBLE) + 0.0 AS y_um FROM orders")
def stage_affine(spark, sf_dir):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    x, y = table.stage_position((F.col("o_orderkey") % 40).cast("double"), (F.col("o_custkey") % 48).cast("double"), F.array("o_totalprice", F.lit(0.0)), arr(2.0, 3.0), arr(48, 40), F.array(arr(0.0, -1.0), arr(1.0, 0.0)))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(x, 6).alias("x_um"), (F.round(y, 6) + 0.0).alias("y_um"))


@query("SELECT page_id, CASE WHEN regexp_matches(n, '_C[0-9]{2}_Z[0-9]{5}\\.ome\\.tiff?$') THEN regexp_replace(n, '_C[0-9]{2}_Z[0-9]{5}\\.ome\\.tiff?$', '') ELSE split_part(n, '.', 1) END AS name FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'tile_' || page_id || '_C00_Z00001.ome.tif' ELSE 'tile-' || page_id || '.v2.tiff' END AS n FROM pages)")
def short_names(spark, sf_dir):
    k = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data/x/tile_"), k, F.lit("_C00_Z00001.ome.tif"))).otherwise(F.concat(F.lit("/data/x/tile-"), k, F.lit(".v2.tiff")))
    return load(spark, sf_dir, "pages").select("page_id", table.short_name(path).alias("name"))


@query("""SELECT p_partkey, sha256('{"cellprob_threshold":null,"channels":null,"diameter":' || p_size || ',"flow_threshold":null,"method":"fast","niter":null,"segmentation_binning":null,"threshold":null,"z_selection":"max"}') AS identity FROM part""")
def segmentation_identity(spark, sf_dir):
    given = F.create_map(F.lit("method"), F.lit('"fast"'), F.lit("z_selection"), F.lit('"max"'), F.lit("diameter"), F.col("p_size").cast("string"), F.lit("min_area_px"), F.lit("3"))
    return load(spark, sf_dir, "part").select("p_partkey", table.identity_column(given).alias("identity"))


@query(PIX + f"SELECT image_id, CAST(r // 2 AS INTEGER) AS r, CAST(c // 2 AS INTEGER) AS c, {r6('avg(v)', 'v')} FROM pixels GROUP BY image_id, r // 2, c // 2")
def box_downsample(spark, sf_dir):
    return rounded(resample.box_downsample(pixels(spark, sf_dir), H, W, 2), "v")


@query(PIX + f"SELECT m.image_id, CAST(a.i AS INTEGER) AS r, CAST(b.j AS INTEGER) AS c, m.label FROM masks m, range({2 * H + 4}) a(i), range({3 * W}) b(j) WHERE m.r = least(a.i * {H} // {2 * H + 4}, {H - 1}) AND m.c = least(b.j * {W} // {3 * W}, {W - 1})")
def nearest_upsample(spark, sf_dir):
    return resample.nearest_upsample(masks(spark, sf_dir), (H, W), (2 * H + 4, 3 * W))


@query(PIX + "SELECT image_id, CAST(r - 10 AS INTEGER) AS r, CAST(c - 12 AS INTEGER) AS c, v FROM pixels WHERE r BETWEEN 10 AND 29 AND c BETWEEN 12 AND 35")
def middle_crop(spark, sf_dir):
    return resample.middle_crop(pixels(spark, sf_dir), (H, W), (20, 24))


_PARTS = "(SELECT i, least(CAST(floor(i * {n} / {m}.0) AS INTEGER) + k, {n}) AS {x}, CASE k WHEN 0 THEN 1 - (i * {n} / {m}.0 - floor(i * {n} / {m}.0)) ELSE i * {n} / {m}.0 - floor(i * {n} / {m}.0) END AS w FROM range({m} + 1) t(i), range(2) u(k))"


@query(PIX + f"SELECT p.image_id, CAST(a.i AS INTEGER) AS r, CAST(b.i AS INTEGER) AS c, round(sum(p.v * a.w * b.w), 4) + 0.0 AS v FROM pixels p JOIN {_PARTS.format(n=H - 1, m=59, x='r')} a ON a.r = p.r JOIN {_PARTS.format(n=W - 1, m=71, x='c')} b ON b.c = p.c GROUP BY p.image_id, a.i, b.i")
def bilinear_zoom(spark, sf_dir):
    return rounded(resample.bilinear_zoom(pixels(spark, sf_dir), (H, W), (60, 72)), "v", digits=4)


_LAYOUT = "list_value(" + ", ".join(
    f"{{'residual': sqrt(pow(a - ({m[0][0]}), 2) + pow(b - ({m[0][1]}), 2) + pow(x - ({m[1][0]}), 2) + pow(y - ({m[1][1]}), 2)), 'n': {n}, 'turn': {turn}, 'mirror': {str(mirror).lower()}, 'sx': '{align.signed_axis(m[0])}', 'sy': '{align.signed_axis(m[1])}'}}"
    for n, ((turn, mirror), m) in enumerate(align.LAYOUTS.items())
) + ")"


@query(f"SELECT case_id, m.turn AS rotation_deg, m.mirror AS reflection, m.sx AS stage_x_from_image, m.sy AS stage_y_from_image, {r6('m.residual', 'residual')} FROM (SELECT case_id, list_sort({_LAYOUT})[1] AS m FROM (SELECT c_custkey AS case_id, (c_custkey % 7 - 3) / 3.0 AS a, (c_custkey % 5 - 2) / 2.0 AS b, (c_custkey % 11 - 5) / 5.0 AS x, (c_custkey % 3 - 1) / 1.0 AS y FROM customer))")
def nearest_layout(spark, sf_dir):
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(k.alias("case_id"), ((k % 7 - 3) / 3.0).alias("m00"), ((k % 5 - 2) / 2.0).alias("m01"), ((k % 11 - 5) / 5.0).alias("m10"), ((k % 3 - 1) / 1.0).alias("m11"))
    return rounded(align.nearest_layout(rows), "residual")


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0 THEN round(o_totalprice / 1000 - 7, 6) END AS dz_um,
  o_orderkey % 10 / 10.0 >= 0.5 AND o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0 AS accepted,
  CASE WHEN NOT (o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0) THEN 'a stack''s sharpest plane is at its end: refocus' WHEN o_orderkey % 10 / 10.0 < 0.5 THEN 'the pictures agree too little' ELSE '' END AS why FROM orders""")
def registration_verdict(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.lit(0.0).alias("dx_um"), F.lit(0.0).alias("dy_um"), F.lit(7.0).alias("z_a"), (F.col("o_totalprice") / 1000).alias("z_b"), (k % 3 != 0).alias("bracketed_a"), (F.col("o_custkey") % 4 != 0).alias("bracketed_b"), (k % 10 / 10.0).alias("agreement")
    )
    return align.registration_verdict(rows).select("case_id", F.round("dz_um", 6).alias("dz_um"), "accepted", "why")


# ---- images


@query(PIX + f"SELECT image_id, r, c, min(label) AS label FROM (SELECT m.image_id, CAST(m.r + a.i AS INTEGER) AS r, CAST(m.c + b.j AS INTEGER) AS c, m.label FROM masks m, range(-1, 2) a(i), range(-1, 2) b(j)) WHERE r BETWEEN 0 AND {H - 1} AND c BETWEEN 0 AND {W - 1} GROUP BY ALL")
def dilate(spark, sf_dir):
    return resample.dilate(masks(spark, sf_dir), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], H, W)


@query(PIX + _STENCIL + "SELECT image_id, r, c, nmzv + npzv + nzmv + nzpv - 4 * v AS v FROM s")
def laplacian(spark, sf_dir):
    return resample.laplacian(pixels(spark, sf_dir))


@query(PIX + """, e AS (SELECT DISTINCT a.image_id, a.label AS u, b.label AS v FROM masks a JOIN masks b ON a.image_id = b.image_id AND ((b.r = a.r AND b.c IN (a.c - 1, a.c + 1)) OR (b.c = a.c AND b.r IN (a.r - 1, a.r + 1)))),
  reach AS (WITH RECURSIVE w AS (SELECT image_id, u, v FROM e UNION SELECT w.image_id, w.u, e.v FROM w JOIN e ON e.image_id = w.image_id AND e.u = w.v) SELECT * FROM w)
  SELECT image_id, u AS label, min(v) AS part FROM reach GROUP BY ALL""")
def connected_parts(spark, sf_dir):
    """Labels that touch, named by the smallest among them: connected components of each image's foreground."""
    import pandas as pd

    def one(rows):
        labels = kernels.plane(rows, "label", H, W)
        parts = kernels.components(labels > 0)
        pairs = pd.DataFrame({"label": labels[labels > 0], "n": parts[labels > 0]}).drop_duplicates()
        pairs["part"] = pairs.groupby("n")["label"].transform("min")
        return pairs.assign(image_id=rows["image_id"].iloc[0])[["image_id", "label", "part"]].drop_duplicates()

    return masks(spark, sf_dir).groupBy("image_id").applyInPandas(one, "image_id long, label int, part int")


@query(PIX + "SELECT image_id, count(*) AS n FROM (SELECT DISTINCT image_id, label FROM masks) GROUP BY image_id")
def object_count(spark, sf_dir):
    return masks(spark, sf_dir).groupBy("image_id").agg(F.count_distinct("label").alias("n"))


@query()
def all_features(spark, sf_dir):
    """Every measure of every object in one table."""
    return features.objects(features.Scene(pixels(spark, sf_dir), masks(spark, sf_dir), H, W), "all")


@query()
def layout_2d(spark, sf_dir):
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return population.layout(suppliers, ["a", "b"])


@query("WITH q AS (SELECT event_type, ts, value FROM events) SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM q GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(e.select("event_type", F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "n", "total"), "total", digits=4)


# ---- scopes: events as submissions, users as carriers, their types as compartments

_SUB = """WITH s AS (SELECT event_id AS job, CAST(user_id % 50 AS VARCHAR) AS carrier, event_type AS compartment, round(value, 2) AS value, event_id % 97 = 5 AS fail, event_id % 11 = 0 AS closes FROM events),
  c AS (SELECT DISTINCT carrier, compartment, job AS close_job FROM s WHERE closes), f AS (SELECT s.carrier, s.compartment, s.job, s.value, s.fail, min(c.close_job) AS close_job FROM s JOIN c ON s.carrier = c.carrier AND s.compartment = c.compartment AND c.close_job >= s.job GROUP BY ALL)"""


def submissions(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("job"), (F.col("user_id") % 50).cast("string").alias("carrier"), F.col("event_type").alias("compartment"), F.round("value", 2).alias("value"), (F.col("event_id") % 97 == 5).alias("fail"), (F.col("event_id") % 11 == 0).alias("closes")
    )


@query(_SUB + f" SELECT carrier, compartment, close_job, {r6('sum(value)', 'total')}, count(*) AS n_inputs FROM f WHERE NOT fail GROUP BY ALL")
def unit_totals_compartment(spark, sf_dir):
    return rounded(scopes.unit_totals(submissions(spark, sf_dir), ["carrier", "compartment"]), "total")


PLAN = Plan("events", (Phase((Step("image"),)), Phase((Step("compartment"),), "compartment"), Phase((Step("carrier"),), "carrier")), ("carrier", "compartment"))


def scoped_board(spark, sf_dir):
    """The board of the events: every eleventh closes its compartment, every 101st its carrier."""
    s = submissions(spark, sf_dir)
    complete = F.concat(F.when(F.col("closes"), F.array(F.lit("compartment"))).otherwise(F.array().cast("array<string>")), F.when(F.col("job") % 101 == 0, F.array(F.lit("carrier"))).otherwise(F.array().cast("array<string>")))
    log = s.select("job", F.create_map(F.lit("carrier"), "carrier", F.lit("compartment"), "compartment").alias("scope"), F.to_json(F.struct("value", "fail")).alias("data"), complete.alias("complete"))
    return scopes.board(log, PLAN)


# a unit ends with its own close or its carrier's; an image goes to the next row of its unit, and a row that has any to the next of its carrier
_BOARD = _SUB.split(",\n  c AS")[0] + """, e AS (SELECT s.job, s.carrier, s.compartment, min(x.job) AS ends FROM s JOIN s x ON s.carrier = x.carrier AND x.job >= s.job AND (x.closes AND x.compartment = s.compartment OR x.job % 101 = 0) GROUP BY ALL),
  r AS (SELECT job, carrier, compartment FROM s WHERE closes UNION SELECT ends, carrier, compartment FROM e),
  a AS (SELECT s.job AS image, s.value, s.fail, s.carrier, s.compartment, min(r.job) AS job FROM s JOIN r ON s.carrier = r.carrier AND s.compartment = r.compartment AND r.job >= s.job GROUP BY ALL),
  u AS (SELECT r.job, r.carrier, r.compartment, coalesce(sum(value) FILTER (NOT fail), 0.0) AS value, count(image) FILTER (NOT fail) AS good, count(image) FILTER (fail) AS bad FROM r LEFT JOIN a ON a.job = r.job AND a.carrier = r.carrier AND a.compartment = r.compartment GROUP BY ALL),
  t AS (SELECT job, carrier FROM s WHERE job % 101 = 0), b AS (SELECT u.*, (SELECT min(t.job) FROM t WHERE t.carrier = u.carrier AND t.job >= u.job) AS up FROM u WHERE good + bad > 0),
  w AS (SELECT t.job, count(b.job) AS n, coalesce(sum(b.value), 0.0) AS value, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM t LEFT JOIN b ON b.carrier = t.carrier AND b.up = t.job GROUP BY ALL)
  SELECT job, NULL::VARCHAR AS level, CASE WHEN fail THEN 'failed' ELSE 'done' END AS state, CASE WHEN NOT fail THEN round(value, 4) + 0.0 END AS value, CASE WHEN fail THEN 'image failed' END AS error, (NOT fail)::INT AS n_jobs, 0 AS n_failed, 1 AS n_inputs FROM s
  UNION ALL SELECT job, 'compartment', CASE WHEN good + bad > 0 THEN 'done' ELSE 'failed' END, CASE WHEN good + bad > 0 THEN round(value, 4) + 0.0 END, CASE WHEN good + bad = 0 THEN 'no images in this compartment' END, good::INT, bad::INT, good::INT FROM u
  UNION ALL SELECT job, 'carrier', CASE WHEN n > 0 THEN 'done' ELSE 'failed' END, CASE WHEN n > 0 THEN round(value, 4) + 0.0 END, CASE WHEN n = 0 THEN 'no images in this carrier' END, good::INT, bad::INT, n::INT FROM w"""


@query(_BOARD)
def scope_board(spark, sf_dir):
    n_jobs = F.when(F.col("level").isNotNull(), F.size("jobs")).otherwise((F.col("state") == "done").cast("int")).alias("n_jobs")
    found = scoped_board(spark, sf_dir).select("job", "level", "state", F.get_json_object("result", "$.value").cast("double").alias("value"), "error", n_jobs, F.size("failed").alias("n_failed"), "n_inputs")
    return rounded(found, "value", digits=4)


@query("SELECT CASE WHEN event_id % 97 = 5 THEN 'failed' ELSE 'done' END AS state, count(*) AS n FROM events GROUP BY ALL")
def board_tallies(spark, sf_dir):
    return scoped_board(spark, sf_dir).where("level is null").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(_SUB + " SELECT carrier, compartment, close_job, list_sort(list(job) FILTER (NOT fail)) AS jobs, count(*) FILTER (fail) AS n_failed FROM f GROUP BY carrier, compartment, close_job HAVING count(*) FILTER (NOT fail) > 0")
def lineage_arrays(spark, sf_dir):
    s = submissions(spark, sf_dir)
    keys = ["carrier", "compartment"]
    own = scopes.closed(s, keys).where("close_job is not null")
    out = own.groupBy(*keys, "close_job").agg(F.sort_array(F.collect_list(F.when(~F.col("fail"), F.col("job")))).alias("jobs"), F.count(F.when(F.col("fail"), 1)).alias("n_failed"))
    return out.where(F.size("jobs") > 0)


@query(_SUB + " SELECT s.carrier, s.compartment, count(*) AS n_open FROM s LEFT JOIN f ON s.carrier = f.carrier AND s.compartment = f.compartment AND s.job = f.job WHERE f.job IS NULL GROUP BY ALL")
def held_notes(spark, sf_dir):
    s = submissions(spark, sf_dir)
    keys = ["carrier", "compartment"]
    last = s.where("closes").groupBy(*keys).agg(F.max("job").alias("last"))
    return s.join(last, keys, "left").where("last is null or job > last").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_open"))


@query("SELECT r_name AS experiment, n_name AS carrier, c_mktsegment AS compartment, " + "round(sum(o_totalprice), 2) AS total" + ", count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def scope_rollup(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("experiment"), F.col("n_name").alias("carrier"), F.col("c_mktsegment").alias("compartment"), "o_totalprice")
    return rounded(rows.rollup("experiment", "carrier", "compartment").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")), "total", digits=2)


# ---- population


@query("WITH m AS (SELECT median(l_tax) FILTER (l_orderkey % 7 <> 0) AS m FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax ELSE m END AS l_tax FROM lineitem, m")
def median_impute(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("l_tax"))
    return population.imputed(lines, ["l_tax"])


@query("WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - b) / (c - a), 6) + 0.0 AS l_quantity FROM lineitem, q")
def robust_scale(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(population.scaled(lines, ["l_quantity"]), "l_quantity")


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0 AS covariance FROM lineitem" for a in _FEATURES for b in _FEATURES))
def covariance_matrix(spark, sf_dir):
    found = population.covariance(load(spark, sf_dir, "lineitem"), _FEATURES)
    rows = [(a, b, float(found[i, j])) for i, a in enumerate(_FEATURES) for j, b in enumerate(_FEATURES)]
    return rounded(spark.createDataFrame(rows, "a string, b string, covariance double"), "covariance", digits=4)


@query("WITH m AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 100) AS b, var_samp(l_tax * 100) AS d FROM lineitem), e AS (SELECT (a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 / (a + d) AS s FROM m) SELECT 1 AS axis, round(s, 6) AS share FROM e UNION ALL SELECT 2, round(1 - s, 6) FROM e")
def explained_variance_2d(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_tax") * 100).alias("l_tax"))
    _, shares, _ = population.principal_axes(lines, ["l_quantity", "l_tax"])
    return spark.createDataFrame([(i + 1, round(float(s), 6)) for i, s in enumerate(shares)], "axis int, share double")


@query()
def pca_points(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), *_FEATURES)
    return population.reduce(lines)[0]


# ---- kernels: rows only


@query()
def object_kernels(spark, sf_dir):
    return kernels.object_kernels(px(spark, sf_dir))


@query()
def watershed_segment(spark, sf_dir):
    found = kernels.segment(pixels(spark, sf_dir), diameter=8.0, threshold=60.0)
    return found.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"))


@query()
def phase_shifts(spark, sf_dir):
    own = pixels(spark, sf_dir)
    a = own.select(F.col("image_id").alias("case_id"), F.lit("a").alias("side"), "r", "c", "v")
    b = own.select(F.col("image_id").alias("case_id"), F.lit("b").alias("side"), ((F.col("r") + 3) % H).alias("r"), ((F.col("c") + 5) % W).alias("c"), "v")
    return kernels.shifts(a.unionByName(b))


@query(PIX + f""", o AS (SELECT image_id, label, count(*) AS area, {r6('avg(r)')} AS y, {r6('avg(c)')} AS x FROM px GROUP BY ALL)
  SELECT 'R' || (image_id % 3) || '_r' || lpad(CAST(image_id % 1000 AS VARCHAR), 3, '0') || '_c007_obj' || lpad(CAST(label AS VARCHAR), 5, '0') AS object_id, area, round(1000 + (x - {W / 2}) * 2, 4) + 0.0 AS stage_x_um, round(2000 + (y - {H / 2}) * 3, 4) + 0.0 AS stage_y_um FROM o""")
def object_table(spark, sf_dir):
    """Images to named, placed objects: the flagship."""
    own = measure.derived(measure.base(px(spark, sf_dir)))
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    k = F.col("s_suppkey").cast("long")
    tiles = P.suppliers(spark, sf_dir).select(
        k.alias("image_id"), F.array(F.concat(F.lit("R"), (k % 3).cast("string")), (k % 1000).cast("string"), F.lit("7")).alias("tile_id"), arr(1000.0, 2000.0).alias("stage_xy"), arr(2.0, 3.0).alias("pixel_xy"), arr(W, H).alias("size_xy"), F.array(arr(1.0, 0.0), arr(0.0, 1.0)).alias("matrix")
    )
    found = table.object_table(own, tiles)
    return rounded(found.select("object_id", "area", "stage_x_um", "stage_y_um"), "stage_x_um", "stage_y_um", digits=4)
