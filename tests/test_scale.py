"""What queries make of larger tables: pixels aren't taken for small, and tasks stay of one size."""

import pytest

from pixelweave import catalog
from pixelweave import pixels as P

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@pytest.mark.parametrize("made", [lambda x: P.scene(x, "id"), lambda x: P.scene_masks(x, "id"), lambda x: P.stack(x, "id")])
def test_pixels_count_as_many(spark, made):
    df = made(spark.range(50))
    assert estimate(df) >= 8 * df.count()


def test_a_task_makes_no_more_pixels_with_more_images(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_PIXELS", 10_000)
    each = P.scene(spark.range(400), "id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(each) == 400 * P.HEIGHT * P.WIDTH
    assert max(each) < 5 * 10_000


def test_stacks_are_dealt_by_all_their_planes(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_PIXELS", 10_000)
    each = P.stack(spark.range(400), "id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(each) == 400 * 12 * 14 * 5 * 2
    assert max(each) < 5 * 10_000


#: Joins of pixels or of objects with each other.
JOINED = "background_anti global_background gradient_prewitt gradient_roberts histogram_texture local_background object_crofton object_kernels object_measures object_perimeter overlap_agreement plane_select texture_scale radius_of_gyration z_mid k_nearest lbp_stats object_table derived_ratios glrlm intensity_focus box_downsample dilate z_max_projection z_mean_projection dropped_union channel_means all_features focus_curves bilinear_zoom".split()


@pytest.mark.parametrize("name", JOINED)
def test_pixels_are_not_broadcast(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "BroadcastHashJoin" not in plan.replace("BroadcastHashJoin [r", "").replace("BroadcastHashJoin [c", "")  # tables of weights
    # nor are they dealt a second time by what they are joined on
    assert not [x for x in plan.splitlines() if "ENSURE_REQUIREMENTS" in x and "r#" in x and "c#" in x]


def test_the_middle_plane_deals_no_pixel_again(spark):
    assert "ENSURE_REQUIREMENTS" not in plan_of(catalog.QUERIES["z_mid"](spark, SF))


def test_runs_are_not_dealt_by_object_again(spark):
    assert "REPARTITION_BY_COL" not in plan_of(catalog.QUERIES["glrlm"](spark, SF))


def test_points_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan_of(catalog.QUERIES["neighbours_within_radius"](spark, SF))
