"""Sources, kernels and the population, on small made inputs."""

import gzip
import json
import zlib
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweave import pixels as P
from pixelweave.operators import align, filters, focus, kernels, measure, population, table, texture
from pixelweave.sources import images
from pixelweave.sources.zarr import Missing

RNG = np.random.default_rng(0)
CUBE = RNG.integers(0, 60_000, (2, 2, 5, 64, 64)).astype(np.uint16)


def store(path, version, codec=None):
    path.mkdir()
    axes = [{"name": a} for a in "tczyx"]
    scales = {"multiscales": [{"axes": axes, "datasets": [{"path": "0"}]}], "omero": {"channels": [{"label": "DAPI"}, {"label": "488"}]}}
    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress}[codec]
    (path / "0").mkdir()
    if version == 2:
        (path / ".zattrs").write_text(json.dumps(scales))
        (path / "0" / ".zarray").write_text(json.dumps({"shape": CUBE.shape, "chunks": [1, 1, 1, 32, 32], "dtype": "<u2", "compressor": {"id": codec} if codec else None, "fill_value": 0}))
    else:
        (path / "zarr.json").write_text(json.dumps({"attributes": {"ome": scales}}))
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])
        (path / "0" / "zarr.json").write_text(json.dumps({"shape": CUBE.shape, "chunk_grid": {"configuration": {"chunk_shape": [1, 1, 1, 32, 32]}}, "data_type": "uint16", "codecs": codecs, "fill_value": 0}))
    for at in np.ndindex(2, 2, 5, 2, 2):
        t, c, z, i, j = at
        data = pack(CUBE[t, c, z, 32 * i : 32 * i + 32, 32 * j : 32 * j + 32].tobytes())
        name = ".".join(map(str, at)) if version == 2 else "c/" + "/".join(map(str, at))
        (path / "0" / name).parent.mkdir(parents=True, exist_ok=True)
        (path / "0" / name).write_bytes(data)


def tiff(path, **how):
    from pixelweave.sources.tiff import write

    xml = '<OME xmlns="x"><Image Name="P1"><Pixels DimensionOrder="XYZCT" SizeX="64" SizeY="64" SizeZ="5" SizeC="2" SizeT="2" PhysicalSizeX="0.325"><Channel Name="DAPI"/><Channel Name="488"/></Pixels></Image></OME>'
    write(str(path), CUBE.reshape(20, 64, 64), xml, **how)


@pytest.mark.parametrize("kind", ["v2", "v2zlib", "v3", "v3gzip", "tiff", "tiled", "deflated"])
def test_planes(spark, tmp_path, kind):
    path = tmp_path / ("a.tif" if kind[0] in "td" else "a.zarr")
    if kind[0] in "td":
        tiff(path, tile=32 if kind == "tiled" else None, deflate=kind == "deflated")
    else:
        store(path, int(kind[1]), kind[2:] or None)
    images.register(spark)
    df = spark.read.format("image_planes").option("path", str(path)).load().where("t = 1 and ch = 0 and z = 3")
    rows = df.select("r", "c", "v").toPandas()
    assert df.rdd.getNumPartitions() == 1
    assert np.array_equal(kernels.plane(rows), CUBE[1, 0, 3])


def test_chunks_read():
    loads = []

    def read(name):
        loads.append(name)
        return None

    from pixelweave.sources.zarr import Store

    docs = {".zattrs": json.dumps({"multiscales": [{"axes": list("zyx"), "datasets": [{"path": "0"}]}]}), "0/.zarray": json.dumps({"shape": [9, 64, 64], "chunks": [1, 32, 32], "dtype": "<u2", "compressor": None})}
    s = Store(lambda n: docs[n].encode() if n in docs else read(n))
    s.array().read((slice(4, 5), slice(None), slice(0, 32)))
    assert s.loads == 2
    with pytest.raises(Missing, match="plate"):
        Store(lambda n: b'{"plate": {}}' if n == ".zattrs" else None, lambda: ["A/1/0/.zattrs"])
    with pytest.raises(ValueError):
        s.level("x")


def test_digest(tmp_path):
    (tmp_path / "d" / "s").mkdir(parents=True)
    (tmp_path / "d" / "b").write_bytes(b"2")
    (tmp_path / "d" / "s" / "a").write_bytes(b"1")
    assert images.digest(str(tmp_path / "d")) == sha256(b"b\x002s/a\x001").hexdigest()
    assert images.digest(str(tmp_path / "d" / "b")) == sha256(b"2").hexdigest()


def test_positions():
    assert [P.z_index(z, 5) for z in (None, "mid", -1, "3")] == [2, 2, 4, 3] and P.bounded(-2, 5, "z") == 3
    for bad in (5, -6):
        with pytest.raises(IndexError):
            P.bounded(bad, 5, "z")
    assert P.first_channels(None, 5) == [0, 1, 2]
    for bad in ([], [0, 1, 2, 3]):
        with pytest.raises(ValueError):
            P.first_channels(bad, 5)


def as_pixels(spark, a, name="v", key="image_id"):
    rows = [(1, int(r), int(c), float(a[r, c])) for r, c in np.ndindex(a.shape) if name == "v" or a[r, c]]
    df = spark.createDataFrame(rows, f"{key} long, r int, c int, {name} double")
    return df if name == "v" else df.withColumn(name, F.col(name).cast("int"))


def test_two_rectangles(spark):
    masks = np.zeros((40, 48), int)
    masks[5:15, 6:14], masks[20:30, 25:41] = 1, 2
    px = measure.of_objects(as_pixels(spark, np.arange(40 * 48).reshape(40, 48)), as_pixels(spark, masks, "label"))
    tiles = spark.createDataFrame([(1, ["R0", "3", "7"], [1000.0, 2000.0], [2.0, 3.0], [48, 40], [[1.0, 0.0], [0.0, 1.0]])], "image_id long, tile_id array<string>, stage_xy array<double>, pixel_xy array<double>, size_xy array<int>, matrix array<array<double>>")
    out = table.object_table(measure.base(px), tiles).orderBy("object_id").collect()
    assert [(r.object_id, r.area, r.stage_x_um, r.stage_y_um) for r in out] == [("R0_r003_c007_obj00001", 80, 971.0, 1968.5), ("R0_r003_c007_obj00002", 160, 1017.0, 2013.5)]
    m = measure.axes(px).orderBy("label").collect()
    assert m[1].major_axis == pytest.approx(4 * np.sqrt((16**2 - 1) / 12)) and m[1].orientation == pytest.approx(np.pi / 2)


def test_filters(spark):
    masks = np.zeros((20, 20), int)
    for k, (a, b) in enumerate(((0, 3), (8, 12), (17, 20)), 1):
        masks[a:b, a:b] = k
    own = as_pixels(spark, masks, "label")
    assert [r.label for r in filters.by_border(own, 4, 20, 20).collect()] == [2]
    assert filters.dropped(own, filters.by_border(own, 4, 20, 20)).first().labels == [1, 3]
    assert sorted(r.label for r in filters.by_area(own, 10, None).collect()) == [2]
    assert filters.area_bounds(0.25, min_diameter=2.0, max_area=10) == (13, 40)
    for bad in ({"min_area": 3, "min_diameter": 1}, {"min_area": -1}, {"min_area": 5, "max_area": 4}):
        with pytest.raises(ValueError):
            filters.area_bounds(1.0, **bad)
    with pytest.raises(ValueError):
        filters.by_border(own, 10, 20, 20)


def test_identity(spark):
    known = {"z_selection": "max", "channels": [0], "method": "fast", "threshold": 100.0, "cellprob_threshold": None, "flow_threshold": None, "niter": None, "diameter": 14, "segmentation_binning": None}
    assert table.identity(known) == table.identity(known | {"min_area_px": 3, "gpu": True}) == "966544120468c6857a2ff30d6d2f58e9bd7da035ddc09b38b4eee2e8536be7f7"
    given = {"method": "m", "threshold": 100.0, "channels": [0]}
    spelled = spark.range(1).select(table.identity_column(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, json.dumps(v, separators=(",", ":")))])))
    assert spelled.first()[0] == table.identity(given) != table.identity({})


def test_blobs():
    y, x = np.mgrid[0:96, 0:96]
    image = sum(1500 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 72) for a in (24, 72) for b in (24, 72))
    assert kernels.find_nuclei(image, 12, 100).max() == 4
    assert kernels.find_nuclei(image, 12, 5000).max() == 0


def test_touching_discs_part():
    y, x = np.mgrid[0:60, 0:80]
    solid = ((y - 30) ** 2 + (x - 28) ** 2 < 144) | ((y - 30) ** 2 + (x - 48) ** 2 < 144)
    d = kernels.distance(solid)
    brute = np.array([[0 if not solid[i, j] else np.sqrt(((np.argwhere(~solid) - (i, j)) ** 2).sum(1).min()) for j in range(80)] for i in range(60)])
    assert np.allclose(d, brute)
    seeds = kernels.components(kernels.peaks(kernels.reconstruct(d - 0.5, d)) & solid)
    parts = kernels.flood(-d, seeds, solid, lines=True)
    assert parts.max() == 2 and (parts[solid] == 0).sum() < 30
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert kernels.fill_holes(ring).sum() == 25


def test_segment_survives_a_failing_image(spark):
    def find(image, **_):
        if image.max() > 5:
            raise ValueError
        return (image > 0).astype(int)

    rows = [(1, 0, 0, 1.0), (1, 0, 1, 0.0), (2, 0, 0, 9.0)]
    out = kernels.segment(spark.createDataFrame(rows, "image_id long, r int, c int, v double"), find).collect()
    assert [(r.image_id, r.label) for r in out] == [(1, 1)]


def test_shifts_are_found(spark):
    a = kernels.gaussian(RNG.normal(size=(80, 80)), 2)
    b = kernels.gaussian(np.pad(a, 4)[8:, 4:-4][:80], 0.3)
    shift, score = kernels.measured_shift(a, a)
    assert shift == (0.0, 0.0) and score > 0.99
    shift, score = kernels.measured_shift(a, np.roll(a, (4, -6), (0, 1)))
    assert shift == (-4.0, 6.0) and score > 0.99
    assert kernels.agreement(a, np.zeros_like(a), (0, 0)) == 0.0
    dx, dy, score = align.register(a, align.middle(b, 76, 80), 2.0, 2.0)
    assert score > 0.5


def test_orientation_of_each_layout(spark):
    rows = []
    for n, m in enumerate(align.LAYOUTS.values()):
        inverse = np.linalg.inv(np.array(m, float))
        x, y = -inverse @ (60, 0) / 2.5, -inverse @ (0, 60) / 2.5
        rows.append((n, float(x[0]), float(x[1]), float(y[0]), float(y[1]), 60.0))
    rows.append((99, 0.0, 0.0, 1.0, 0.0, 60.0))
    out = {r.case_id: r for r in align.orientation_document(spark.createDataFrame(rows, "case_id int, x_dc double, x_dr double, y_dc double, y_dr double, move_um double")).collect()}
    assert [(out[n].rotation_deg, out[n].reflection) for n in range(8)] == list(align.LAYOUTS) and (out[3].stage_x_from_image, out[3].stage_y_from_image) == ("+Y", "-X") and all(out[n].accepted and out[n].pixel_um == pytest.approx(2.5) for n in range(8))
    assert not out[99].accepted and "did not move" in out[99].why


def test_focus(spark):
    base = RNG.normal(size=(64, 64)) * 100
    planes = [kernels.gaussian(base, abs(z - 4.3) + 0.4) + 500 for z in range(9)]
    rows = [(1, z, int(r), int(c), float(p[r, c])) for z, p in enumerate(planes) for r, c in np.ndindex(p.shape)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["stack_id", "z", "r", "c", "v"]))
    heights = spark.createDataFrame([(1, z, 100.0 + 2 * z) for z in range(9)], "stack_id long, z long, z_um double")
    out = focus.peak(focus.brenner(df), "brenner", 2, heights).first()
    assert out.best == 4 and out.found and abs(out.z_um - 108.6) < 0.5
    curve = focus.brenner(df).join(heights, ["stack_id", "z"])
    assert focus.sharp_height(curve, "brenner").first().bracketed
    assert not focus.sharp_height(curve.where("z >= 4"), "brenner").first().bracketed
    small = df.where("r < 12 and c < 14")
    found = {r.z: r.dct_entropy for r in focus.dct_entropy(small, 12, 14).collect()}
    for z, p in enumerate(planes):
        assert found[z] == pytest.approx(kernels.dct_entropy(p[:12, :14]), abs=1e-6)


def test_texture_against_numpy(spark):
    a, labels = RNG.integers(0, 200, (9, 11)).astype(float), (RNG.random((9, 11)) < 0.7).astype(int)
    px = measure.of_objects(as_pixels(spark, a), as_pixels(spark, labels, "label"))
    scale = spark.createDataFrame([(1, 199.0)], "image_id long, scale double")
    got = sorted((r.g, r.length) for r in texture.runs(px, scale).collect())
    q = np.where(labels, np.floor(a / 199 * 15).astype(int) + 1, 0)
    lines = [*q, *q.T, *[q.diagonal(k) for k in range(-8, 11)], *[q[:, ::-1].diagonal(k) for k in range(-8, 11)]]
    expected = []
    for line in lines:
        i = 0
        while i < len(line):
            j = i
            while j < len(line) and line[j] == line[i]:
                j += 1
            if line[i]:
                expected.append((line[i], j - i))
            i = j
    assert got == sorted(expected)
    patterns = {(r.r, r.c): r.lbp for r in texture.binary_patterns(as_pixels(spark, a), 9, 11).collect()}
    wide = np.pad(a, 2)
    for (r, c), code in patterns.items():
        own = 0
        for k in range(8):
            dy, dx = round(-np.sin(2 * np.pi * k / 8), 5), round(np.cos(2 * np.pi * k / 8), 5)
            y, x = r + 2 + dy, c + 2 + dx
            i, j = int(np.floor(y)), int(np.floor(x))
            v = sum(wide[i + p, j + s] * (1 - abs(y - i - p)) * (1 - abs(x - j - s)) for p in (0, 1) for s in (0, 1))
            own |= int(round(v - a[r, c], 6) >= 0) << k
        assert code == own


def test_hull():
    r, c = map(np.ravel, np.mgrid[0:4, 0:7])
    area, solidity, widest = kernels.convexity(r, c)
    assert (area, solidity) == (28, 1.0) and widest == pytest.approx(np.hypot(4, 7))
    corner = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]
    assert kernels.convexity(*map(np.array, zip(*corner)))[1] < 1


def test_population(spark, tmp_path):
    n = 60
    a = RNG.normal(size=n)
    pdf = pd.DataFrame({"field": 1, "id": [f"o{i}" for i in range(n)], "area": a * 3, "mean_c1": a + RNG.normal(size=n) * 0.1, "intensity": a, "bg_global_mean_c0": a, "weighted_centroid_r": a, "stage_z": a, "ecc": RNG.random(n), "const": 2.0, "rarely": [1.0 if i % 5 == 0 else None for i in range(n)]})
    pdf.loc[3, "area"] = None
    pdf.to_csv(tmp_path / "p.csv", index=False)
    ids = spark.createDataFrame([(f"o{i}",) for i in range(0, n, 3)] + [("unknown",)], "id string")
    table_ = population.read_population(spark, str(tmp_path / "p.csv"))
    assert population.read_population(spark, str(tmp_path / "p.csv"), ids).count() == 20
    points, facts = population.reduce(table_)
    assert facts["features"] == ["area", "ecc", "mean_c1"] and sum(facts["variance"]) == pytest.approx(1)
    assert points.count() == n and facts["variance"] == sorted(facts["variance"], reverse=True)
    x = pdf[["area", "ecc", "mean_c1"]].fillna(pdf[["area", "ecc", "mean_c1"]].median())
    q = x.quantile([0.25, 0.5, 0.75])
    x = (x - q.loc[0.5]) / (q.loc[0.75] - q.loc[0.25])
    assert np.allclose(facts["variance"], np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1] / np.trace(np.cov(x.T)))
    with pytest.raises(ValueError):
        population.reduce(table_.limit(5))
    spots = spark.createDataFrame([(i, float(i % 2 * 20 + RNG.normal()), float(RNG.normal())) for i in range(80)], "id long, a double, b double")
    out = population.layout(spots, ["a", "b"], neighbours=8).toPandas().sort_values("id")
    y = out[["x", "y"]].to_numpy()
    near = [np.argsort(((y - p) ** 2).sum(1))[1] % 2 == i % 2 for i, p in enumerate(y)]
    assert np.mean(near) > 0.95 and np.array_equal(y, population.layout(spots, ["a", "b"], neighbours=8).toPandas().sort_values("id")[["x", "y"]].to_numpy())


def test_curves_have_every_measure(spark):
    planes = spark.createDataFrame([("s", z, r, c, float((r * 7 + c * 3 + z) % 5)) for z in range(2) for r in range(4) for c in range(5)], "stack_id string, z int, r int, c int, v double")
    out = {(r.z, r.measure): r.score for r in focus.curves(planes, 4, 5).collect()}
    assert sorted(out) == [(z, m) for z in range(2) for m in ("brenner", "dct_entropy", "intensity", "vollath_f4")]
    assert all(out[r.z, "dct_entropy"] == pytest.approx(r.dct_entropy) for r in focus.dct_entropy(planes, 4, 5).collect())


def test_layout_of_more_than_twenty_thousand(spark):
    n = 20_500
    spots = spark.range(n).select("id", (F.col("id") % 151).cast("double").alias("a"), F.floor(F.col("id") / 151).cast("double").alias("b"))
    out = population.layout(spots, ["a", "b"], neighbours=4, rounds=5).toPandas()
    assert sorted(out["id"]) == list(range(n)) and len(out[["x", "y"]].drop_duplicates()) == n


def test_nearest_rows():
    for x in (RNG.normal(size=(700, 3)), RNG.integers(0, 4, (700, 2)).astype(float), np.zeros((300, 2))):
        at, far = population.nearest_rows(x[100:250], x, 100, 5, tile=64)
        d = np.sqrt(((x[100:250, None] - x[None]) ** 2).sum(2))
        d[np.arange(150), np.arange(100, 250)] = np.inf
        want = np.argsort(d, axis=1, kind="stable")[:, :5]
        assert np.array_equal(at, want) and np.allclose(far, np.take_along_axis(d, want, axis=1))


def test_features_by_family(spark):
    from pixelweave.operators import features

    assert features.expand("gradient") == ["prewitt", "roberts"] and features.expand(["lbp", "background"]) == ["global_background", "local_background", "lbp"]
    assert len(features.expand("all")) == len(features.EXTRAS)
    with pytest.raises(ValueError):
        features.expand("unknown")
    masks = np.zeros((12, 12), int)
    masks[4:8, 4:8] = 1
    scene = features.Scene(as_pixels(spark, np.full((12, 12), 3.0)), as_pixels(spark, masks, "label"), 12, 12, bg_radius=1)
    row = features.objects(scene, ["background", "gyration"]).first()
    assert (row.area, row.area_convex, row.bg_global_mean, row.bg_local_mean, row.solidity) == (16, 16, 3.0, 3.0, 1.0)
    assert row.intensity_cv == 0.0 and row.intensity_radial_variance == pytest.approx(1.0)


def test_neighbours_and_background_of_a_ring(spark):
    from pixelweave.operators import features

    masks = np.zeros((14, 14), int)
    masks[3:8, 3:8] = 1
    masks[4:7, 4:7] = 0
    masks[10:12, 5:6] = 2
    image = np.full((14, 14), 2.0)
    image[4:7, 4:7], image[masks > 0] = 90.0, 6.0
    scene = features.Scene(as_pixels(spark, image), as_pixels(spark, masks, "label"), 14, 14, bg_radius=2)
    row = features.objects(scene, ["background", "neighbours"]).where("label = 1").first()
    assert (row.bg_local_mean, row.mean_minus_local_bg, row.mean_over_local_bg, row.total_minus_local_bg, row.total_over_local_bg) == (2.0, 4.0, 3.0, 64.0, 48.0)
    assert (row.neighbours_within_5, row.neighbours_within_50, row.neighbours_within_250) == (0, 1, 1)


def test_sinks(spark, tmp_path):
    from pixelweave.sources import sinks

    own = as_pixels(spark, np.eye(3, dtype=int), "label")
    sinks.checkpoint(own, own, {"diameter": 3}, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c" / "masks")).count() == 3
    assert spark.read.json(str(tmp_path / "c" / "detection")).first().diameter == "3"
    assert sinks.points_name("/a/b_objects.csv", "pca") == "b_pca.csv"
    sinks.points(spark.createDataFrame([("a", 1.0)], "id string, pca_1 double"), str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).first().id == "a"


def test_fourier_energy_is_a_sum():
    a = RNG.normal(size=(6, 7))
    m = np.abs(np.fft.fft2(a))
    assert kernels.spectrum(a)[2] == pytest.approx((m**2).sum()) == pytest.approx(42 * (a**2).sum())


def test_points_of_other_images_are_no_neighbours(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (2, 1, 0.0, 0.0), (2, 2, 9.0, 0.0)]
    points = spark.createDataFrame(rows, "image long, id long, x double, y double")
    assert sorted((r.image, r.id, r.neighbours) for r in measure.within(points, 5.0, "id", "image").collect()) == [(1, 1, 1), (1, 2, 1), (2, 1, 0), (2, 2, 0)]


def test_no_height_without_a_peak(spark):
    rows = [(1, z, s) for z, s in enumerate([5.0, 4.0, 3.0, 2.0, 1.0])] + [(2, z, s) for z, s in enumerate([1.0, 2.0, 4.0, 3.0, 1.0])]
    curve = spark.createDataFrame(rows, "stack_id long, z long, score double")
    heights = curve.select("stack_id", "z", (F.col("z") * 2.0).alias("z_um"))
    out = {r.stack_id: r for r in focus.peak(curve, "score", 0, heights).collect()}
    assert (out[1].found, out[1].z_um) == (False, None) and out[2].found and 4.0 < out[2].z_um < 5.0


def test_patterns_are_of_eight_bits(spark):
    """Neighbours that fall into the same of 256 levels are equal."""
    a = np.full((5, 5), 1000.0)
    a[2, 2], a[2, 3] = 1003.0, 1001.0
    labels = np.ones((5, 5), int)
    pixels, masks = as_pixels(spark, a), as_pixels(spark, labels, "label")
    scales = spark.createDataFrame([(1, 2000.0)], "image_id long, scale double")
    code = {(r.r, r.c): r.lbp for r in texture.binary_patterns(texture.eight_bit(pixels, scales), 5, 5).collect()}
    assert code[2, 2] == 255 and texture.binary_patterns(pixels, 5, 5).where("r = 2 and c = 2").first().lbp == 0
    assert texture.lbp_stats(texture.binary_patterns(texture.eight_bit(pixels, scales), 5, 5), masks).count() == 1


def test_template_where_phase_fails():
    a, b = RNG.normal(size=(40, 40)), RNG.normal(size=(40, 40))
    shift, score = kernels.measured_shift(a, b)
    assert shift == kernels.template_shift(a, b) and score == kernels.agreement(a, b, shift) < 0.5


@pytest.mark.parametrize("move", [(0, 0), (3, -2), (-5, 7), (-1, -1)])
def test_agreement_over_what_both_show(move):
    a, b = RNG.normal(size=(20, 24)), RNG.normal(size=(20, 24))
    pairs = [(a[r, c], b[r - move[0], c - move[1]]) for r in range(20) for c in range(24) if 0 <= r - move[0] < 20 and 0 <= c - move[1] < 24]
    assert kernels.agreement(a, b, move) == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])
    assert kernels.agreement(a, b, (19, 22)) == 0.0 == kernels.agreement(a, b, (50, 0)) == kernels.agreement(a, np.ones_like(a), (0, 0))


def test_detection_from_end_to_end(spark, tmp_path):
    """Binning, detection, border, area; masks found again by their settings, whatever the filters."""
    a = np.zeros((24, 32))
    a[0:4, 0:4], a[8:12, 8:12], a[8:18, 18:28] = 9, 9, 9
    calls = []

    def find(image, diameter, threshold):
        calls.append(image.shape)
        return kernels.components(image > threshold)

    pixels = as_pixels(spark, a)
    settings = {"segmentation_binning": 2, "diameter": 8, "threshold": 4.0, "method": "parts"}
    from pixelweave.operators import segmentation

    out = segmentation.detected(pixels, 24, 32, settings, find, border=2, area=(20, None), folder=str(tmp_path))
    assert not out.reused and {(r.label, r.n) for r in out.masks.groupBy("label").agg(F.count("*").alias("n")).collect()} == {(3, 100)}
    assert out.dropped.first().labels == [1, 2] and out.counts().first()[1:] == (3, 1)
    again = segmentation.detected(pixels, 24, 32, settings | {"gpu": False}, None, folder=str(tmp_path))
    assert again.reused and again.identity == out.identity and again.counts().first()[1:] == (3, 3)
    assert not segmentation.detected(pixels, 24, 32, settings | {"threshold": 5.0}, find, folder=str(tmp_path)).reused


def test_spacing(spark):
    labels = np.zeros((6, 6), int)
    labels[1:3, 2:6] = 1
    px = measure.of_objects(as_pixels(spark, labels * 2.0), as_pixels(spark, labels, "label"))
    row = measure.derived(measure.spaced(measure.base(px), (2.0, 0.5))).first()
    assert (row.num_pixels, row.area, row.centroid_r, row.centroid_c, row.intensity_total) == (8, 8.0, 3.0, 1.75, 16.0)
