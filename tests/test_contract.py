import duckdb
import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_queries import rows_of
from slidelake import functions as fn
from slidelake.operators.analysis import AnalysisSpec
from slidelake.operators.levels import with_level_mpp
from slidelake.plans import pipelines

SF = "/root/testdata/sf0.001"
SAMPLE = ["p01_plan_levels", "s07_pack_tiles", "v04_visible_tiles", "v15_budget_prefetch", "v21_tileset_changes", "a03_query_viewports",
          "a10_apply_changes", "c04_dedupe_cells", "g09_breakdown", "b05_recent"]


def test_flagship_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["slide_id", "level", "n_tiles", "n_viewports"] and df.count() > 0


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_queries_agree_with_their_checks(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("part", "events", "orders", "lineitem", "supplier", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = contract.queries()[name](spark, SF)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cursor.fetchall(), columns)


def test_addresses_and_colours(spark):
    urls = ["2/3_4?g=7", "2/3_4", "2/3_4?x=1", "2/3_4?g=x", "2/3", "a/1_2", "1/2_3_4", "1/2/3_4", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(fn.parse_tile_url(F.col("u")).alias("t"))
    got = [tuple(r.t) if r.t else None for r in df.collect()]
    assert got == [(2, 3, 4, 7), (2, 3, 4, 0), (2, 3, 4, 0)] + [None] * 7
    colors = spark.createDataFrame([(c,) for c in ("#12ab9f", "12AB9F", "#fff", "zz0000", "", None)], "c string")
    assert [tuple(r[0]) for r in colors.select(fn.parse_hex_color(F.col("c"))).collect()] == [(18, 171, 159)] * 2 + [(255, 107, 107)] * 4


def test_tile_keys(spark):
    df = spark.createDataFrame([(0, 0, 0), (12, 16777215, 16777215), (65535, 5, 9)], "level int, col int, row int")
    keyed = df.withColumn("k", fn.tile_key(F.col("level"), F.col("col"), F.col("row")))
    assert keyed.filter("level = 12").first().k == (12 << 48) | (16777215 << 24) | 16777215
    assert rows(keyed.select(fn.tile_key_parts(F.col("k")).alias("p")).select("p.*"), "level", "col", "row") == rows(df, "level", "col", "row")


def test_build_and_analyse_end_to_end(spark):
    px = np.random.default_rng(11).integers(0, 256, (40, 56, 3), dtype=np.uint8)
    slides = spark.createDataFrame([(1, 56, 40, 16, 0.5)], "slide_id bigint, width int, height int, tile_size int, target_mpp double")
    images = spark.createDataFrame([(1, 56, 40, px.tobytes())], "slide_id bigint, width int, height int, rgb binary")
    levels, tiles = pipelines.build_pyramids(images, slides, 16)
    assert tiles.count() == levels.selectExpr("sum(cols * rows)").first()[0]
    rois = spark.createDataFrame([(5, 1, 3.0, 4.0, 20.0, 30.0)], "request_id int, slide_id bigint, x double, y double, w double, h double")
    spec = AnalysisSpec("sum", "total bigint", process=lambda r: {"total": int(np.frombuffer(r.rgb.iloc[0], np.uint8).astype(int).sum())})
    done = pipelines.analyze_regions(rois, tiles, with_level_mpp(levels, slides), spec, 16).first()
    assert done.success and done.total == int(px[4:34, 3:23].astype(int).sum())


def test_planning_end_to_end(spark):
    found = spark.createDataFrame([(1, 2048, 1024, 512, {"aperio.MPP": "0.25"}), (2, 512, 512, 512, {})],
                                  "slide_id bigint, width int, height int, tile_size int, props map<string,string>")
    status = spark.createDataFrame([(2, "complete", False)], "slide_id bigint, status string, native_mpp_mode boolean")
    plan, levels = pipelines.plan_pyramids(found, status)
    assert rows(plan, "slide_id", "out_width", "out_height") == [(1, 1024, 512)]
    assert rows(levels, "slide_id", "level", "downsample", "cols", "rows") == [(1, 0, 2, 1, 1), (1, 1, 1, 2, 1)]
