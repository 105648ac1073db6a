from pyspark.sql import functions as F

from pixelweave import functions as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert value(spark, X.tile_name(arr("R 0", "3", "7", "a/b"))) == "R-0_r003_c007_a-b"
    assert value(spark, X.tile_name(arr("x y", "z"))) == "x-y_z" and value(spark, X.tile_name(arr("R0", "a", "7"))) == "R0_a_7"
    assert value(spark, X.object_id(F.lit("t"), F.lit(12))) == "t_obj00012"
    assert value(spark, X.slug(F.lit("//"))) == "item" and value(spark, X.slug(F.lit("-a b-"))) == "a-b"
    assert value(spark, X.short_name(F.lit("/a/data/w_C01_Z00012.ome.tiff"))) == "w" and value(spark, X.short_name(F.lit("w.x.tif"))) == "w"
    assert value(spark, X.analysis_folder(F.lit("/a/data/b/data/c.tif"))) == "/a/data/b/analysis" and value(spark, X.analysis_folder(F.lit("/a/b.tif"))) is None


def test_numbers(spark):
    assert value(spark, X.in_micrometres(F.lit(2.0), F.lit(" NM "))) == 2e-3 and value(spark, X.in_micrometres(F.lit(2.0), F.lit("ly"))) is None
    assert value(spark, X.finite(F.lit(float("nan")))) is None and value(spark, X.finite(F.lit(-float("inf")))) is None and value(spark, X.finite(F.lit(1.5))) == 1.5
    assert [value(spark, X.skip_of(F.lit(n), s)) for n, s in ((9, 2), (9, 5), (1, 2), (4, 9))] == [2, 4, 0, 1]
    assert value(spark, X.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert [value(spark, c) for c in X.negative_inverse(*[F.lit(float(x)) for x in (2, 0, 0, 4)])] == [-0.5, 0.0, 0.0, -0.25]
    assert value(spark, X.negative_inverse(*[F.lit(1.0)] * 4)[0]) is None


def test_setting_named_null_wins(spark):
    none, empty = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    params = F.create_map(F.lit("k"), F.lit("p"))
    assert value(spark, X.setting(F.create_map(F.lit("k"), none), params, "k", F.lit("d"))) is None
    assert value(spark, X.setting(empty, params, "k", F.lit("d"))) == "p" and value(spark, X.setting(empty, empty, "k", F.lit("d"))) == "d"
