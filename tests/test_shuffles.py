"""Tables that grow with the data are never copied to the driver and every executor, and busy keys still spread."""

import pytest

from slidelake.operators.skew import default_salts, salted_join
from slidelake.plans import catalog
from slidelake.sources.tilestore import payload_moves

#: Queries whose joins all meet slides, levels, tiles or folders.
GROWING = """
    a04_annotations_by_tile c01_patch_grid c02_eligible c05_cells_to_annotations s07_pack_tiles serve_viewports
    v01_level_for_scale v03_level_info v04_visible_tiles_scheduler v05_tile_position v06_tile_bounds v07_transforms
    v08_tiles_in_roi v09_get_tiles v10_assemble_regions v13_extend_viewport v14_rank_prefetch v15_budget_prefetch
"""
FOLDERS = "p05_pyramid_status p06_plan_batch"
STORED = "p13_missing_tiles p14_validate_index v18_preload_worklist v18_preload_counts"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_copies(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("name", GROWING.split())
def test_levels_and_slides_are_shuffled(spark, name):
    no_copies(spark, name)


@pytest.mark.parametrize("name", STORED.split())
def test_tiles_are_shuffled(spark, name):
    no_copies(spark, name)


@pytest.mark.parametrize("name", FOLDERS.split())
def test_folder_listings_are_shuffled(spark, name):
    no_copies(spark, name)


def test_an_index_is_checked_where_it_lies(spark):
    assert payload_moves(catalog.QUERIES["p14_validate_index"](spark, "/root/testdata/sf0.001"), "offset") == []


def test_salts_only_where_joins_are_not_split(spark):
    left = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    right = spark.range(3).selectExpr("id AS k").groupBy("k").count()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        assert default_salts(left) == 1
        assert "Generate explode" not in plan_of(salted_join(left, right, ["k"]))  # the right side is not repeated
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        assert default_salts(left) == 8
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert default_salts(left) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_busy_key_of_a_grouped_table_is_split(spark):
    """Adaptive execution divides the shuffle of a key that holds nearly all rows."""
    left = spark.range(200_000, numPartitions=8).selectExpr("if(id % 50 = 0, id, 7) AS k", "id AS v")
    right = spark.range(0, 200_000, 1, 4).selectExpr("id AS k").groupBy("k").count()
    small = {
        "advisoryPartitionSizeInBytes": "16k", "skewJoin.skewedPartitionThresholdInBytes": "16k",
        "skewJoin.skewedPartitionFactor": "1.5", "coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(f"spark.sql.adaptive.{k}", None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
        joined = salted_join(left, right, ["k"])
        assert len(joined.collect()) == 200_000
        assert "skew=true" in plan_of(joined)
    finally:
        for k, v in old.items():
            spark.conf.unset(f"spark.sql.adaptive.{k}") if v is None else spark.conf.set(f"spark.sql.adaptive.{k}", v)
