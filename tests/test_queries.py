import pytest

from rasterlake.plans.oracle import ORACLE_SQL
from rasterlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3


def test_scan_pushes_columns(spark):
    plan = QUERIES["manifest_pair"](spark, SF)._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1]


def test_picked_images_are_picked_by_the_scan(spark):
    from rasterlake.sources import rasters

    some = rasters.rasters(spark, SF, "img_id BETWEEN 5 AND 7")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,5)" in plan and "LessThanOrEqual(vec_id,7)" in plan and "SortMergeJoin" not in plan
    every = {r.img_id: r for r in rasters.rasters(spark, SF).collect()}
    assert {r.img_id: r for r in some.collect()} == {k: every[k] for k in (5, 6, 7)}


def test_an_image_is_four_counts_before_it_moves(spark):
    plan = QUERIES["iou_confusion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_losses_are_worked_out_once(spark):
    plan = QUERIES["cls_pseudo"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "embeddings" not in plan
