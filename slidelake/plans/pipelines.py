"""The end-to-end jobs: build and store pyramids, serve viewports, analyse regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.functions import format_tile_url
from slidelake.operators.analysis import AnalysisSpec, run_analysis
from slidelake.operators.levels import resolve_regions
from slidelake.operators.pixels import build_pyramid_tiles, cut_tiles, resample_to, thumbnails
from slidelake.operators.pyramid import plan_batch, plan_levels, plan_resize, resolve_mpp
from slidelake.operators.regions import assemble_regions
from slidelake.operators.viewport import (
    budget_prefetch, filter_cached, rank_prefetch, tile_position, visible_tiles,
)
from slidelake.session import cut_lineage
from slidelake.sources.files import write_files
from slidelake.sources.packs import write_packs
from slidelake.sources.slides import metadata_documents
from slidelake.sources.tilestore import write_tile_store


def plan_pyramids(discovered: DataFrame, status: DataFrame, native: bool = False, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Slides to build with their resize plan, and the levels of their pyramids.

    ``discovered`` carries ``width, height, tile_size`` and scanner ``props``.
    """
    todo = plan_batch(discovered, status, force, native).filter(F.col("action") == "build")
    plan = plan_resize(resolve_mpp(todo), native=native)
    sized = plan.select(
        "slide_id", F.col("out_width").alias("width"), F.col("out_height").alias("height"), "tile_size"
    )
    return plan, plan_levels(sized)


def build_pyramids(images: DataFrame, slides: DataFrame, tile_size: int = S.TILE_SIZE) -> tuple[DataFrame, DataFrame]:
    """Levels and all tiles of decoded images at their final resolution."""
    levels = plan_levels(slides)
    finest = levels.filter(F.col("downsample") == 1).select("slide_id", "level")
    base = write_tile_store(cut_tiles(images.join(finest, "slide_id"), tile_size))
    return levels, build_pyramid_tiles(base, slides, levels, written=True)


def image_problems(images: DataFrame, tile_size: int) -> DataFrame:
    """``(slide_id, width, height, problem)`` of images given whole or as strips; ``problem`` is null for a good one.

    The strips of a slide, by ``y_offset``, must follow one another without gap
    or overlap, have one width, begin at multiples of the tile size and hold the
    bytes of their size.  Only sizes are read, so a slide's strips never meet.
    """
    strips = images if "y_offset" in images.columns else images.withColumn("y_offset", F.lit(0))
    fits = (F.col("width") > 0) & (F.col("height") > 0) & (F.length("rgb") == F.col("width").cast("bigint") * F.col("height") * 3)
    facts = strips.select(
        "slide_id", "width", F.col("height").cast("bigint").alias("height"), F.col("y_offset").cast("bigint").alias("y_offset"),
        F.coalesce(fits, F.lit(False)).alias("fits"),
    )
    top, end = F.col("y_offset"), F.col("y_offset") + F.col("height")
    told = facts.groupBy("slide_id").agg(
        F.max("width").alias("width"), F.max(end).alias("total"), F.sum("height").alias("covered"), F.min("width").alias("narrowest"),
        F.min("fits").alias("fits"), F.max(top % tile_size).alias("shift"), F.min(top).alias("first"),
        F.count(F.lit(1)).alias("strips"), F.count_distinct(top).alias("offsets"),
        F.bit_xor(F.xxhash64(top)).alias("tops"), F.bit_xor(F.xxhash64(end)).alias("ends"),
    )
    # Every strip but the last ends where another begins: both sets of places then hash alike.
    chained = F.col("tops").bitwiseXOR(F.xxhash64(F.lit(0).cast("bigint"))) == F.col("ends").bitwiseXOR(F.xxhash64("total"))
    whole = (F.col("first") == 0) & (F.col("covered") == F.col("total")) & (F.col("strips") == F.col("offsets")) & chained
    problem = (
        F.when(~F.col("fits"), "image bytes do not fit its size")
        .when(F.col("narrowest") != F.col("width"), "strips differ in width")
        .when(F.col("shift") != 0, "strip offsets must be multiples of the tile size")
        .when(~whole, "strips leave a gap or overlap")
    )
    return told.select("slide_id", "width", F.col("total").cast("int").alias("height"), problem.alias("problem"))


def _encoded(images: DataFrame, keys: list[str], encode: Callable[[int, int, bytes], bytes] | None) -> DataFrame:
    """``keys, data, error``: the file bytes of each image; what ``encode`` raises stays with its row."""
    if encode is None:
        return images.select(*keys, F.col("rgb").alias("data"), F.lit(None).cast("string").alias("error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data, errors = [], []
            for w, h, rgb in zip(frame["width"], frame["height"], frame["rgb"]):
                try:
                    data.append(bytes(encode(int(w), int(h), bytes(rgb))))
                    errors.append(None)
                except Exception as error:  # whatever user code raises fails its slide alone
                    data.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield frame[keys].assign(data=data, error=errors)

    schema = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.select(*keys, "width", "height", "rgb").mapInPandas(run, f"{schema}, data binary, error string")


def dead_letters(results: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Failed slides of a run with the number of attempts so far: ``(slide_id, file, stage, error, attempts)``.

    ``before`` is this table of the run before; slides done since then leave it,
    and slides that this run did not touch keep their row.
    """
    failed = results.filter(F.col("status") == "error").select("slide_id", "file", "stage", "error")
    if before is None:
        return failed.withColumn("attempts", F.lit(1))
    counted = failed.join(before.select("slide_id", F.col("attempts").alias("_before")), "slide_id", "left").withColumn(
        "attempts", F.coalesce("_before", F.lit(0)) + 1
    ).drop("_before")
    return counted.unionByName(before.select(*counted.columns).join(results.select("slide_id"), "slide_id", "left_anti"))


def build_job(
    images: DataFrame, slides: DataFrame, root: str, status: DataFrame | None = None, native: bool = False,
    tile_size: int = S.TILE_SIZE, encode: Callable[[int, int, bytes], bytes] | None = None, made_at: str = "1970-01-01",
    retries: DataFrame | None = None, max_attempts: int = 3,
) -> DataFrame:
    """Build and store the pyramids of decoded images; one row ``(slide_id, file, status, stage, error)`` per slide.

    ``images(slide_id, width, height, rgb[, y_offset])`` holds what could be
    decoded, whole or, for slides of any size, in strips whose offsets are
    multiples of the tile size; ``slides(slide_id, path, props)`` what was found,
    ``status`` what is there already (see ``plan_batch``).  A slide without an
    image, with one whose bytes do not fit, or one that ``encode`` cannot write
    fails alone, with the stage (``input``, ``tiles``, ``thumbnail``) and the
    message.  Slides that ``retries`` (see ``dead_letters``) counts
    ``max_attempts`` times are left alone.

    Tiles are written once after cutting, once per level and once encoded; the
    stages meet by tile key, where the pixels lie.  Packs, thumbnail and, last,
    the metadata go below ``root/<slide_id>/``, where ``pyramid_status`` looks
    for them.  ``encode`` turns raw RGB into file bytes; tiles and thumbnails
    stay raw without it.
    """
    spark = slides.sparkSession
    sid = slides.schema["slide_id"].dataType.simpleString()
    checked = image_problems(images, tile_size)
    if status is None:
        status = spark.createDataFrame([], f"slide_id {sid}, status string, native_mpp_mode boolean")
    given_up = spark.createDataFrame([], f"slide_id {sid}, attempts int") if retries is None else retries.select("slide_id", "attempts")
    found = slides.join(checked, "slide_id", "left").join(given_up, "slide_id", "left").withColumn(
        "problem", F.when(F.col("attempts") >= max_attempts, F.concat(F.lit("given up after "), F.col("attempts"), F.lit(" attempts")))
        .when(F.col("width").isNull(), "no image").otherwise(F.col("problem"))
    ).drop("attempts")
    planned = plan_batch(found, status, native=native)
    plan = cut_lineage(plan_resize(resolve_mpp(planned.drop("status")), native=native).withColumn("tile_size", F.lit(tile_size)))
    todo = plan.filter((F.col("action") == "build") & F.col("problem").isNull())
    sized = todo.select("slide_id", F.col("out_width").alias("width"), F.col("out_height").alias("height"), "tile_size")
    levels = cut_lineage(plan_levels(sized))
    finest = levels.filter(F.col("downsample") == 1).select("slide_id", "level")
    strips = images.join(todo.select("slide_id"), "slide_id", "left_semi").withColumn("level", F.lit(0))
    cut = write_tile_store(cut_tiles(strips, tile_size))
    resampled = resample_to(cut, todo, F.col("resize_factor"), out_tile_size=tile_size)
    base = write_tile_store(resampled.join(finest, "slide_id"))
    tiles = build_pyramid_tiles(base, sized, levels, written=True)
    files = write_tile_store(_encoded(tiles, ["slide_id", "level", "col", "row"], encode))
    thumbs = cut_lineage(_encoded(thumbnails(tiles, sized, levels), ["slide_id"], encode))
    where = F.concat(F.lit("level "), F.col("level"), F.lit(", column "), F.col("col"), F.lit(", row "), F.col("row"), F.lit(": "), F.col("error"))
    broken = files.filter(F.col("error").isNotNull()).groupBy("slide_id").agg(
        F.min_by(where, F.struct("level", "row", "col")).alias("failure")
    ).withColumn("failed_in", F.lit("tiles")).unionByName(
        thumbs.filter(F.col("error").isNotNull()).select("slide_id", F.col("error").alias("failure"), F.lit("thumbnail").alias("failed_in"))
    )
    broken = cut_lineage(broken.groupBy("slide_id").agg(F.max_by(F.struct("failed_in", "failure"), "failed_in").alias("f")).select("slide_id", "f.*"))
    fine = lambda df: df.join(broken.select("slide_id"), "slide_id", "left_anti")
    # Only tiles of these levels are packed.
    write_packs(files.filter(F.col("error").isNull()).select("slide_id", "level", "col", "row", "data"), fine(levels), root)
    below = lambda name: F.concat(F.col("slide_id").cast("string"), F.lit("/" + name)).alias("path")
    write_files(fine(thumbs).select(below("thumbnail.jpg"), F.col("data").alias("content")), root)
    facts = fine(todo).select(
        "slide_id", F.lit("1.0").alias("version"), F.col("path").alias("source_file"), "source_mpp", F.col("actual_mpp").alias("target_mpp"),
        F.col("magnification").alias("target_magnification"), "tile_size", F.col("out_width").alias("width"), F.col("out_height").alias("height"),
        F.array(*[F.lit(c) for c in S.BACKGROUND]).alias("background_color"), F.lit(made_at).cast("timestamp").alias("preprocessed_at"),
        F.lit(native).alias("native_mpp_mode"),
    )
    documents = metadata_documents(facts, fine(levels))
    write_files(documents.select(below("metadata.json"), F.encode("document", "UTF-8").alias("content")), root)
    failure = F.when(F.col("action") != "skip", F.coalesce("problem", "failure"))
    state = F.when(F.col("action") == "skip", "skipped").when(failure.isNull(), "done").otherwise("error")
    stage = F.when(state == "error", F.when(F.col("problem").isNotNull(), "input").otherwise(F.col("failed_in")))
    return plan.join(broken, "slide_id", "left").select(
        "slide_id", F.col("path").alias("file"), state.alias("status"), stage.alias("stage"), failure.alias("error")
    )


def serve_viewports(viewports: DataFrame, slides: DataFrame, levels: DataFrame, cached: DataFrame, generation: int = 0) -> DataFrame:
    """Tiles to show per viewport with their place and address."""
    shown = filter_cached(visible_tiles(viewports, levels), cached)
    placed = tile_position(shown.select("viewport_id", "slide_id", "level", "col", "row"), slides, levels)
    return placed.withColumn(
        "url", format_tile_url(F.col("level"), F.col("col"), F.col("row"), F.lit(generation).cast("bigint"))
    )


def prefetch_viewports(viewports: DataFrame, levels: DataFrame, cached: DataFrame) -> DataFrame:
    """Tiles to load per viewport, ranked and cut to the budget."""
    return budget_prefetch(rank_prefetch(viewports, levels, cached))


def analyze_regions(
    rois: DataFrame, tiles: DataFrame, levels: DataFrame, spec: AnalysisSpec, tile_size: int = S.TILE_SIZE,
    block_pixels: int = (1 << 31) // 3,
) -> DataFrame:
    """Resolve ROIs to pixels at the analysis' resolution and run it on each; one row per request.

    ``rois`` carries ``request_id``.  Without a ``merge`` an analysis sees whole
    regions; one of more than ``block_pixels``, which no image row can hold, then
    comes out as failed.  With a ``merge``, ``process`` gets an iterator over a
    region's row blocks (``y_offset``), so regions of any size are analysed.
    """
    resolved = resolve_regions(rois, levels, spec.working_mpp)
    requests = resolved.select(
        "request_id", "slide_id", "level", F.col("level_x").alias("x"), F.col("level_y").alias("y"),
        F.col("level_w").alias("w"), F.col("level_h").alias("h"),
    )
    if spec.merge is not None:
        whole = replace(spec, input_kind="whole_slide", keys=("request_id",))
        return run_analysis(whole, assemble_regions(requests, tiles, tile_size, block_pixels))
    small = F.col("w").cast("bigint") * F.col("h") <= block_pixels
    done = run_analysis(spec, assemble_regions(requests.filter(small), tiles, tile_size, block_pixels))
    failed = {
        "request_id": F.col("request_id"), "success": F.lit(False), "processing_time": F.lit(0.0),
        "message": F.lit("region too large for one piece; the analysis needs a merge"),
    }
    return done.unionByName(
        requests.filter(~small).select(*[failed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in done.schema.fields])
    )
