"""Catalogue: sources, sinks, pyramid planning and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake import functions as fn
from slidelake.operators import pyramid as P
from slidelake.operators.ordering import number_rows
from slidelake.operators.skew import shuffled
from slidelake.operators.viewport import preload_order
from slidelake.plans.bridge import Bridge, oracle
from slidelake.plans.registry import query
from slidelake.session import cut_to_buckets, local_path, scratch_path
from slidelake.sources import geojson, packs, projects
from slidelake.sources import slides as sources

TILE = ["slide_id", "level", "col", "row"]

# --- planning -------------------------------------------------------------


@query("p01_plan_levels", oracle('SELECT slide_id, level, downsample, cols, "rows" FROM b_levels', "b_levels"))
def _(b: Bridge) -> DataFrame:
    return b.levels.drop("tile_size")


_PROPS = """CASE p_size % 5 WHEN 0 THEN '0.24' WHEN 1 THEN '-1' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE '0' END"""
_APERIO = """CASE p_size % 3 WHEN 0 THEN '0.5' WHEN 1 THEN NULL ELSE 'x' END"""


@query("p02_resolve_mpp", f"""
    SELECT slide_id, CASE WHEN TRY_CAST(a AS DOUBLE) > 0 THEN TRY_CAST(a AS DOUBLE) WHEN TRY_CAST(m AS DOUBLE) > 0
           THEN TRY_CAST(m AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS source_mpp
    FROM (SELECT p_partkey AS slide_id, {_PROPS} AS a, {_APERIO} AS m FROM part)""")
def _(b: Bridge) -> DataFrame:
    props = b.table("part").selectExpr(
        "p_partkey AS slide_id", f"map('openslide.mpp-x', {_PROPS}, 'aperio.MPP', {_APERIO}) AS props"
    )
    return P.resolve_mpp(props).select("slide_id", "source_mpp")


_RESIZE = """
    SELECT slide_id, round(f, 6) AS resize_factor, round(a, 6) AS actual_mpp,
           round(CASE WHEN a > 0 THEN 10 / a ELSE 10 END, 6) AS magnification, {coarser} AS coarser_than_target,
           CAST(round(width * f) AS INTEGER) AS out_width, CAST(round(height * f) AS INTEGER) AS out_height
    FROM (SELECT *, {factor} AS f, {actual} AS a FROM b_slides)"""


def _resized(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("resize_factor", "actual_mpp", "magnification")}
    return df.withColumns(rounded).select(
        "slide_id", "resize_factor", "actual_mpp", "magnification", "coarser_than_target", "out_width", "out_height"
    )


@query("p03_plan_resize", oracle(_RESIZE.format(
    coarser="source_mpp > 0.5",
    factor="CASE WHEN source_mpp < 0.5 THEN source_mpp / 0.5 ELSE CAST(1 AS DOUBLE) END",
    actual="CASE WHEN source_mpp < 0.5 THEN CAST(0.5 AS DOUBLE) ELSE source_mpp END"), "b_slides"))
def _(b: Bridge) -> DataFrame:
    return _resized(P.plan_resize(b.slides))


@query("p03_plan_resize_native", oracle(_RESIZE.format(
    coarser="false", factor="CAST(1 AS DOUBLE)", actual="source_mpp"), "b_slides"))
def _(b: Bridge) -> DataFrame:
    return _resized(P.plan_resize(b.slides, native=True))


@query("p04_pyramid_name", oracle(r"""
    SELECT slide_id, concat(stem, '.pyramid') AS name, concat(stem, '.pyramid_native') AS native_name FROM (
        SELECT slide_id, regexp_replace(regexp_extract(path, '[^/]+$'), '(.)\.[^.]+$', '\1') AS stem FROM b_slides)""", "b_slides"))
def _(b: Bridge) -> DataFrame:
    return b.slides.select(
        "slide_id", P.pyramid_name(F.col("path")).alias("name"),
        P.pyramid_name(F.col("path"), native=True).alias("native_name"),
    )


# Folder states by part: what is listed and what its metadata says.
_DOC = """CASE p_size % 6 WHEN 0 THEN '{"version": "1.0"' WHEN 1 THEN '{"version": "1.0", "tile_size": 512}'
    WHEN 2 THEN '{"version": "1", "source_file": "a", "tile_size": 512, "dimensions": [1, 1], "levels": [], "tile_format": "v1"}'
    ELSE concat('{"version": "1", "source_file": "a", "tile_size": 512, "dimensions": [1, 1], "levels": [{"level": 0}, {"level": ',
                p_partkey % 3 + 1, '}], "tile_format": "pack_v2"}') END"""


def _folders(b: Bridge) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = b.table("part")
    listing = part.selectExpr(
        "p_partkey AS slide_id",
        """explode(filter(array(
            CASE WHEN p_partkey % 13 > 0 THEN '' END,
            CASE WHEN p_partkey % 13 > 1 THEN 'metadata.json' END,
            CASE WHEN p_partkey % 13 > 2 THEN 'tiles' END,
            CASE WHEN p_partkey % 13 > 3 THEN 'tiles/level_0.pack' END,
            CASE WHEN p_partkey % 13 > 4 THEN 'tiles/level_0.idx' END,
            CASE WHEN p_partkey % 13 > 5 THEN 'tiles/level_1.pack' END,
            CASE WHEN p_partkey % 13 > 5 THEN 'tiles/level_1.idx' END,
            CASE WHEN p_partkey % 13 > 6 THEN 'tiles/level_2.pack' END,
            CASE WHEN p_partkey % 13 > 6 THEN 'tiles/level_2.idx' END,
            CASE WHEN p_partkey % 13 > 7 THEN 'thumbnail.jpg' END), p -> p IS NOT NULL)) AS rel_path""",
    )
    return part.selectExpr("p_partkey AS slide_id"), listing, part.selectExpr("p_partkey AS slide_id", f"{_DOC} AS document")


_STATUS = """
    SELECT p_partkey AS slide_id, CASE
        WHEN s = 0 THEN 'not_exists' WHEN s = 1 THEN 'incomplete'
        WHEN p_size % 6 <= 2 THEN 'corrupted'
        WHEN s <= 4 THEN 'incomplete'
        WHEN s < CASE p_partkey % 3 + 1 WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE 99 END THEN 'incomplete'
        WHEN s <= 7 THEN 'incomplete' ELSE 'complete' END AS status
    FROM (SELECT *, p_partkey % 13 AS s FROM part)"""


@query("p05_pyramid_status", _STATUS)
def _(b: Bridge) -> DataFrame:
    return P.pyramid_status(*_folders(b))


@query("p06_plan_batch", f"""
    SELECT slide_id, CASE WHEN status = 'complete' THEN 'skip' ELSE 'build' END AS action, status,
           status = 'complete' AND slide_id % 2 = 1 AS mode_mismatch FROM ({_STATUS})""")
def _(b: Bridge) -> DataFrame:
    expected, listing, metadata = _folders(b)
    status = P.pyramid_status(expected, listing, metadata).withColumn("native_mpp_mode", F.col("slide_id") % 2 == 1)
    return P.plan_batch(expected, status).select("slide_id", "action", "status", "mode_mismatch")


_RESULTS = ["p_name || ' ' || p_partkey || '.svs' AS file",
            "CASE p_size % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' WHEN 2 THEN 'error' ELSE 'done' END AS status",
            "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE NULL END AS error"]


@query("p07_summarize_batch", f"""
    SELECT count(*) FILTER (WHERE status = 'done') AS processed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
           count(*) FILTER (WHERE status = 'error') AS failed FROM (SELECT {', '.join(_RESULTS)} FROM part)""")
def _(b: Bridge) -> DataFrame:
    return P.summarize_batch(b.table("part").selectExpr(*_RESULTS))


@query("p07_batch_failures", f"""
    SELECT file, coalesce(error, 'Unknown error') AS error FROM (SELECT {', '.join(_RESULTS)} FROM part) WHERE status = 'error'""")
def _(b: Bridge) -> DataFrame:
    return P.batch_failures(b.table("part").selectExpr(*_RESULTS))


@query("p12_validate_slides", oracle("""
    SELECT slide_id, rule, level FROM (
        SELECT p_partkey AS slide_id, 'dimensions' AS rule, CAST(NULL AS INTEGER) AS level FROM part WHERE p_size % 10 = 0
        UNION ALL SELECT p_partkey, 'tile_size', NULL FROM part WHERE p_size % 7 = 0
        UNION ALL SELECT slide_id, 'levels_empty', NULL FROM b_slides WHERE slide_id IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT slide_id, 'downsample', level FROM b_levels WHERE slide_id NOT IN (SELECT s_suppkey FROM supplier) AND downsample >= 16
        UNION ALL SELECT slide_id, 'rows', level FROM b_levels WHERE slide_id NOT IN (SELECT s_suppkey FROM supplier) AND "rows" > 12
        UNION ALL SELECT slide_id, 'cols', level FROM b_levels WHERE slide_id NOT IN (SELECT s_suppkey FROM supplier) AND cols > 15
        UNION ALL SELECT slide_id, 'duplicate_level', 1 FROM b_levels WHERE slide_id NOT IN (SELECT s_suppkey FROM supplier)
                  GROUP BY slide_id HAVING count(*) FILTER (WHERE level IN (1, 4)) = 2)""", "b_slides", "b_levels"))
def _(b: Bridge) -> DataFrame:
    slides = b.table("part").selectExpr(
        "p_partkey AS slide_id", "CASE WHEN p_size % 10 = 0 THEN 0 ELSE 100 END AS width", "100 AS height",
        "CASE WHEN p_size % 7 = 0 THEN 0 ELSE 512 END AS tile_size",
    )
    broken = b.levels.join(
        b.table("supplier").selectExpr("s_suppkey AS slide_id"), "slide_id", "left_anti"
    ).selectExpr(
        "slide_id", "CASE WHEN level = 4 THEN 1 ELSE level END AS number", "level",
        "CASE WHEN downsample >= 16 THEN 0 ELSE downsample END AS downsample",
        "CASE WHEN cols > 15 THEN 0 ELSE cols END AS cols", "CASE WHEN rows > 12 THEN 0 ELSE rows END AS rows",
    )
    renumbered = broken.selectExpr("slide_id", "number AS level", "downsample", "cols", "rows")
    others = P.validate_slides(slides, broken.drop("number")).filter("rule <> 'duplicate_level'")
    return others.unionByName(P.validate_slides(slides, renumbered).filter("rule = 'duplicate_level'"))


@query("p13_missing_tiles", oracle('SELECT slide_id, level, col, "row" FROM b_index WHERE length = 0', "b_index"))
def _(b: Bridge) -> DataFrame:
    return P.missing_tiles(b.levels, b.tile_index)


_PACKED = """
    SELECT *, coalesce(sum(length) OVER (PARTITION BY slide_id, level ORDER BY "row", col
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b_index"""


@query("p14_validate_index", oracle(f"""
    SELECT slide_id, level, col, "row", CAST(start + shift AS BIGINT) AS "offset", length,
           start + shift + length > pack AS out_of_pack, shift <> before AS not_contiguous FROM (
        SELECT *, coalesce(lag(shift) OVER (PARTITION BY slide_id, level ORDER BY "row", col), 0) AS before FROM (
            SELECT *, CASE WHEN col % 7 = 3 THEN 5 ELSE 0 END AS shift,
                   sum(length) OVER (PARTITION BY slide_id, level) AS pack FROM ({_PACKED})) WHERE length > 0)
    WHERE start + shift + length > pack OR shift <> before""", "b_index"))
def _(b: Bridge) -> DataFrame:
    # Offsets are made grid row by grid row, so the index lies as it is checked.
    index = cut_to_buckets(packs.pack_tiles(b.tile_index, b.levels), "slide_id", "level", "row")
    totals = index.groupBy("slide_id", "level").agg(F.sum("length").alias("pack_length"))
    shifted = index.withColumn("offset", F.expr("offset + CASE WHEN col % 7 = 3 THEN 5 ELSE 0 END"))
    return P.validate_index(shifted, totals)


# --- sources and sinks ----------------------------------------------------


def _write_files(df: DataFrame, root: str) -> None:
    """Write small files named by ``path`` (below a root) with ``content`` from Spark tasks."""
    import os

    base = local_path(root)

    def save(batches):
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                path = os.path.join(base, f.path)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write(f.content)
            yield pdf[["path"]]

    df.select("path", "content").mapInPandas(save, "path string").write.format("noop").mode("overwrite").save()


_FILES = ["concat(CASE s_suppkey % 4 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END, s_name, CASE s_suppkey % 5 WHEN 0 THEN '.svs' WHEN 1 THEN '.NDPI' WHEN 2 THEN '.Tiff' WHEN 3 THEN '.jpg' ELSE '' END) AS path",
          "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS content"]


@query("s01_discover_slides", f"""
    SELECT regexp_extract(path, '^.[^.]+') AS stem, lower(regexp_extract(path, '[.][^.#]*$')) AS ext, CAST(length(content) AS BIGINT) AS length
    FROM (SELECT {', '.join(_FILES)} FROM supplier) WHERE lower(regexp_extract(path, '[.][^.#]*$')) IN ('.svs', '.ndpi', '.tiff')""")
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "slides")
    _write_files(b.table("supplier").selectExpr(*_FILES).withColumn("content", F.encode("content", "utf-8")), root)
    return sources.discover_slides(b.spark, root).select("stem", "ext", "length")


_FOLDER = ["concat('/data/', p_brand) AS parent",
           "concat(CASE p_size % 2 WHEN 0 THEN upper(p_name) ELSE p_name END, ' ', p_partkey, CASE p_size % 4 WHEN 3 THEN '.pyramid_native' ELSE '.pyramid' END) AS name"]
_SIBLINGS = f"""
    folders AS (SELECT p_partkey, {', '.join(_FOLDER)} FROM part),
    listed AS (SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY lower(name), name) - 1 AS idx,
                      count(*) OVER (PARTITION BY parent) AS n FROM folders WHERE name LIKE '%.pyramid'),
    opened AS (SELECT s_suppkey AS viewer_id, CASE WHEN s_suppkey % 9 = 0 THEN '/none' ELSE f.parent END AS parent, f.name
               FROM supplier JOIN folders f ON f.p_partkey = s_suppkey),
    placed AS (SELECT o.viewer_id, o.parent, CASE WHEN s.n IS NULL THEN -1 ELSE coalesce(a.idx, 0) END AS current_idx, coalesce(s.n, 0) AS n
               FROM opened o LEFT JOIN (SELECT DISTINCT parent, n FROM listed) s USING (parent) LEFT JOIN listed a ON a.parent = o.parent AND a.name = o.name)"""


def _siblings(b: Bridge) -> DataFrame:
    folders = b.table("part").selectExpr("p_partkey", *_FOLDER)
    opened = b.table("supplier").join(folders, F.col("s_suppkey") == F.col("p_partkey")).selectExpr(
        "s_suppkey AS viewer_id", "CASE WHEN s_suppkey % 9 = 0 THEN '/none' ELSE parent END AS parent", "name"
    )
    return sources.sibling_slides(folders.select("parent", "name"), opened)


@query("s02_sibling_slides", f"""
    WITH {_SIBLINGS} SELECT p.viewer_id, p.parent, l.name, l.idx, p.n, CAST(p.current_idx AS BIGINT) AS current_idx FROM placed p LEFT JOIN listed l ON l.parent = p.parent""")
def _(b: Bridge) -> DataFrame:
    return _siblings(b).select("viewer_id", "parent", "name", "idx", "n", "current_idx")


@query("v17_preload_order", f"""
    WITH {_SIBLINGS} SELECT p.viewer_id, l.name, row_number() OVER (PARTITION BY p.viewer_id ORDER BY abs(l.idx - p.current_idx), l.idx < p.current_idx) - 1 AS preload_rank
    FROM placed p JOIN listed l ON l.parent = p.parent WHERE p.n > 1""")
def _(b: Bridge) -> DataFrame:
    return preload_order(_siblings(b)).select("viewer_id", "name", "preload_rank")


def _metadata(b: Bridge) -> tuple[DataFrame, DataFrame]:
    """All slides with full metadata, and their levels."""
    slides = b.slides.selectExpr(
        "slide_id", "'1.0' AS version", "path AS source_file", "source_mpp", "target_mpp",
        "10 / target_mpp AS target_magnification", "tile_size", "width", "height",
        "array(255, 255, 255) AS background_color", "TIMESTAMP '2024-05-06 07:08:09.123456' AS preprocessed_at",
        "slide_id % 2 = 0 AS native_mpp_mode",
    )
    return slides, b.levels


@query("s03_s04_metadata_levels", oracle("""
    SELECT concat(s.slide_id, '') AS slide_id, s.width, s.height, s.slide_id % 2 = 0 AS native_mpp_mode,
           l.level, l.downsample, l.cols, l."rows", round(s.target_mpp * l.downsample, 6) AS mpp
    FROM b_slides s JOIN b_levels l ON l.slide_id = s.slide_id""", "b_slides", "b_levels"))
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "metadata")
    sources.write_slides(*_metadata(b), root)
    slides, levels, _ = sources.read_slides(b.spark, root)
    return slides.select("slide_id", "width", "height", "native_mpp_mode").join(
        shuffled(levels.drop("tile_size").withColumn("mpp", F.round("mpp", 6))), "slide_id"
    )


@query("s03_metadata_rejects", f"""
    SELECT concat(p_partkey, '') AS slide_id, CASE p_size % 6 WHEN 0 THEN 'malformed JSON' WHEN 1 THEN 'unsupported tile_format: none'
           WHEN 2 THEN 'unsupported tile_format: v1'
           ELSE 'missing keys: source_mpp, target_mpp, target_magnification, background_color, preprocessed_at' END AS reason
    FROM part""")
def _(b: Bridge) -> DataFrame:
    documents = b.table("part").selectExpr("concat('m/', p_partkey) AS path", "concat(p_partkey, '') AS slide_id", f"{_DOC} AS document")
    return sources.slides_from_documents(documents)[2].select("slide_id", "reason")


def _pack_store(b: Bridge) -> tuple[str, DataFrame]:
    """A packed store of 2 x 3 grids per supplier; tile (1, 1) is missing."""
    root = scratch_path(b.spark, "store")
    levels = b.table("supplier").selectExpr("s_suppkey AS slide_id", "0 AS level", "2 AS cols", "3 AS rows")
    tiles = b.table("supplier").selectExpr(
        "s_suppkey AS slide_id", "0 AS level", "s_name",
        "explode(array(named_struct('col', 0, 'row', 0), named_struct('col', 1, 'row', 0), named_struct('col', 0, 'row', 1), "
        "named_struct('col', 0, 'row', 2), named_struct('col', 1, 'row', 2))) AS t",
    ).selectExpr(
        "slide_id", "level", "t.col", "t.row",
        "encode(concat(s_name, '-', t.col, '-', t.row, repeat('x', CAST(slide_id % 17 AS INT))), 'utf-8') AS data",
    )
    packs.write_packs(tiles, levels, root)
    return root, levels


_STORE = """
    SELECT s_suppkey AS slide_id, 0 AS level, c AS col, r AS "row",
           CASE WHEN c = 1 AND r = 1 THEN NULL ELSE concat(s_name, '-', c, '-', r, repeat('x', s_suppkey % 17)) END AS data
    FROM supplier, (SELECT unnest([0, 1]) AS c), (SELECT unnest([0, 1, 2]) AS r)"""


@query("s05_tile_index", f"""
    SELECT concat(slide_id, '') AS slide_id, level, col, "row", coalesce(length(data), 0) AS length,
           CAST(CASE WHEN data IS NULL THEN 0 ELSE coalesce(sum(length(data)) OVER (PARTITION BY slide_id ORDER BY "row", col
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS "offset" FROM ({_STORE})""")
def _(b: Bridge) -> DataFrame:
    root, _ = _pack_store(b)
    return packs.read_tile_index(b.spark, root)[0].select(*TILE, "length", "offset")


@query("s06_tile_bytes", f"""SELECT concat(slide_id, '') AS slide_id, level, col, "row", data, CAST(NULL AS VARCHAR) AS error FROM ({_STORE})""")
def _(b: Bridge) -> DataFrame:
    root, _ = _pack_store(b)
    index, _ = packs.read_tile_index(b.spark, root)
    return packs.read_tile_bytes(index, index.select(*TILE)).withColumn("data", F.col("data").cast("string"))


@query("s07_pack_tiles", oracle(f"""
    SELECT slide_id, level, col, "row", length, CAST(CASE WHEN length > 0 THEN start ELSE 0 END AS BIGINT) AS "offset" FROM ({_PACKED})""", "b_index"))
def _(b: Bridge) -> DataFrame:
    return packs.pack_tiles(b.tile_index.filter("length > 0"), b.levels)


@query("s08_dz_tree", """
    SELECT concat('slide ', s_suppkey) AS slide_id, CAST(s_suppkey % 4 AS INTEGER) AS level, CAST(s_suppkey % 3 AS INTEGER) AS col,
           CAST(s_suppkey % 5 AS INTEGER) AS "row", length(s_name) AS length FROM supplier WHERE s_suppkey % 7 <> 6""")
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "tree")
    files = b.table("supplier").selectExpr(
        "concat('slide ', s_suppkey, '/tiles_files/', s_suppkey % 4, '/', s_suppkey % 3, '_', s_suppkey % 5, "
        "CASE WHEN s_suppkey % 7 = 6 THEN '.png' WHEN s_suppkey % 2 = 0 THEN '.jpg' ELSE '.jpeg' END) AS path",
        "encode(s_name, 'utf-8') AS content",
    )
    _write_files(files, root)
    return packs.read_dz_tree(b.spark, root, with_data=False)


@query("s10_s11_geojson_round_trip", oracle("""
    SELECT concat(slide_id, '') AS slide_id, annotation_id, type, min_x, min_y, max_x, max_y, coalesce(label, '') AS label,
           coalesce(color, '#ff6b6b') AS color, grp AS "group",
           CASE type WHEN 'point' THEN 1 WHEN 'rectangle' THEN 2 ELSE 4 END AS n_points,
           CAST(row_number() OVER (PARTITION BY slide_id ORDER BY seq) - 1 AS INTEGER) AS pos FROM b_boxes""", "b_boxes"))
def _(b: Bridge) -> DataFrame:
    from slidelake.operators.annotations import normalize_annotations, with_bounds

    documents = geojson.annotation_documents(b.annotations.withColumnRenamed("seq", "pos"), max_features=5)
    annotations, _ = geojson.parse_documents(
        documents.selectExpr("concat(slide_id, '/', part) AS path", "concat(slide_id, '') AS slide_id", "document")
    )
    return normalize_annotations(with_bounds(annotations)).select(
        "slide_id", "annotation_id", "type", "min_x", "min_y", "max_x", "max_y", "label", "color", "group",
        F.size("coordinates").alias("n_points"), "pos",
    )


@query("s10_split_documents", oracle("""
    SELECT slide_id % 3 AS slide, CAST(row_number() OVER (PARTITION BY slide_id % 3 ORDER BY slide_id, seq) - 1 AS INTEGER) AS pos,
           annotation_id, type, min_x, max_y, coalesce(label, '') AS label FROM b_boxes""", "b_boxes"))
def _(b: Bridge) -> DataFrame:
    """Documents of up to 1000 features for every third slide together, read in ranges of 16 KB."""
    from slidelake.operators.annotations import normalize_annotations, with_bounds

    root = scratch_path(b.spark, "features")
    merged = number_rows(b.annotations.withColumn("third", F.expr("slide_id % 3")), ["third"], ["slide_id", "seq"], "pos")
    texts = geojson.annotation_documents(merged.drop("slide_id", "seq").withColumnRenamed("third", "slide_id"), max_features=1000)
    _write_files(texts.selectExpr("concat('slide_id=', slide_id, '/', part, '.geojson') AS path", "encode(document, 'utf-8') AS content"), root)
    annotations, _ = geojson.read_annotations(b.spark, root, split_bytes=1 << 14, chunk_bytes=1 << 14)
    return normalize_annotations(with_bounds(annotations)).select(
        F.col("slide_id").cast("bigint").alias("slide"), "pos", "annotation_id", "type", "min_x", "max_y", "label"
    )


@query("s10_geojson_rejects", """
    SELECT concat(o_orderkey, '') AS slide_id, pos, reason FROM (
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 1 END AS pos,
               CASE o_orderkey % 4 WHEN 0 THEN 'malformed JSON' WHEN 1 THEN 'missing features' WHEN 2 THEN 'bad coordinates' END AS reason
        FROM orders) WHERE reason IS NOT NULL""")
def _(b: Bridge) -> DataFrame:
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}'
    bad = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":"none"}}'
    documents = b.table("orders").selectExpr(
        "concat('a/', o_orderkey) AS path", "concat(o_orderkey, '') AS slide_id",
        "CASE o_orderkey % 4 WHEN 0 THEN '{\"features\": [' WHEN 1 THEN '{\"type\": \"FeatureCollection\"}' "
        f"WHEN 2 THEN '{{\"features\": [{point}, {bad}]}}' ELSE '{{\"features\": [{point}]}}' END AS document",
    )
    return geojson.parse_documents(documents)[1].select("slide_id", "pos", "reason")


_PROJECT = """CASE c_custkey % 4 WHEN 0 THEN '{"version": "1.0", "slide_path": "/s/1", "view_state": {"x": 5, "scale": 0.5}, "metadata": {"a": 1}}'
    WHEN 1 THEN concat('{"slide_path": "/s/', c_custkey, '", "annotations_file": "/a/', c_custkey % 50, '"}')
    WHEN 2 THEN '{"version": "2.0"}' ELSE '{"version": "1.0", ' END"""
_PROJECTS_READ = """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN '2.0' ELSE '1.0' END AS version,
           CASE c_custkey % 4 WHEN 0 THEN '/s/1' WHEN 1 THEN concat('/s/', c_custkey) ELSE '' END AS slide_path,
           CASE WHEN c_custkey % 4 = 1 THEN concat('/a/', c_custkey % 50) ELSE '' END AS annotations_file,
           CAST(CASE WHEN c_custkey % 4 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS x,
           CAST(CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE 0.1 END AS DOUBLE) AS scale,
           c_custkey % 4 <> 2 AS known_version FROM customer WHERE c_custkey % 4 <> 3"""


def _projects(b: Bridge) -> DataFrame:
    documents = b.table("customer").selectExpr("concat(c_custkey, '') AS path", f"{_PROJECT} AS document")
    return projects.parse_projects(documents)[0]


@query("s12_projects", f"SELECT concat(c_custkey, '') AS path, version, slide_path, annotations_file, x, scale, known_version FROM ({_PROJECTS_READ})")
def _(b: Bridge) -> DataFrame:
    again = projects.project_documents(_projects(b)).select("path", "document")
    return projects.parse_projects(again)[0].select(
        "path", "version", "slide_path", "annotations_file", "view_state.x", "view_state.scale", "known_version"
    )


@query("s13_check_projects", f"""
    SELECT concat(c_custkey, '') AS path, CASE WHEN slide_path = '' THEN 'missing slide path'
           WHEN slide_path NOT IN (SELECT concat('/s/', s_suppkey) FROM supplier) THEN 'slide not found'
           ELSE 'annotation file not found' END AS reason
    FROM ({_PROJECTS_READ}) WHERE slide_path = '' OR slide_path NOT IN (SELECT concat('/s/', s_suppkey) FROM supplier)
       OR (annotations_file <> '' AND annotations_file NOT IN (SELECT concat('/a/', n_nationkey) FROM nation))""")
def _(b: Bridge) -> DataFrame:
    slides = b.table("supplier").selectExpr("concat('/s/', s_suppkey) AS slide_path")
    files = b.table("nation").selectExpr("concat('/a/', n_nationkey) AS path")
    return projects.check_projects(_projects(b), slides, files).select("path", "reason")


# --- scalar functions -----------------------------------------------------

_URL = """CASE event_id % 6 WHEN 0 THEN concat(event_id % 5, '/', user_id, '_', event_id, '?g=', event_id % 9)
    WHEN 1 THEN concat(event_id % 5, '/', user_id, '_', event_id) WHEN 2 THEN concat(event_id, '/', user_id)
    WHEN 3 THEN concat('x', event_id, '/1_2?g=1') WHEN 4 THEN concat(event_id % 5, '/3_4?g=', event_type)
    ELSE concat(event_id % 5, '/', user_id, '_0?h=7') END"""


@query("f01_parse_tile_url", """
    SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 5) THEN CAST(event_id % 5 AS INTEGER) END AS level,
           CASE WHEN event_id % 6 IN (0, 1, 5) THEN CAST(user_id AS INTEGER) END AS col,
           CASE event_id % 6 WHEN 0 THEN CAST(event_id AS INTEGER) WHEN 1 THEN CAST(event_id AS INTEGER) WHEN 5 THEN 0 END AS "row",
           CASE event_id % 6 WHEN 0 THEN event_id % 9 WHEN 1 THEN 0 WHEN 5 THEN 0 END AS generation FROM events""")
def _(b: Bridge) -> DataFrame:
    return b.table("events").selectExpr("event_id", f"{_URL} AS url").select(
        "event_id", fn.parse_tile_url(F.col("url")).alias("t")
    ).select("event_id", "t.*")


@query("f02_format_tile_url", oracle("""
    SELECT slide_id, concat(level, '/', col, '_', "row", '?g=', slide_id % 10) AS url FROM b_grid""", "b_grid"))
def _(b: Bridge) -> DataFrame:
    return P.grid(b.levels).select(
        "slide_id", fn.format_tile_url(F.col("level"), F.col("col"), F.col("row"), F.col("slide_id") % 10).alias("url")
    )


_COLOR = """CASE o_orderkey % 4 WHEN 0 THEN concat('#', lpad(concat('', o_orderkey), 6, '0')) WHEN 1 THEN lpad(concat('', o_custkey), 6, '0')
    WHEN 2 THEN '#fff' ELSE '#zz0000' END"""


def _hex_part(start: int, default: int) -> str:
    return f"CASE WHEN o_orderkey % 4 <= 1 THEN CAST(concat('0x', substr(digits, {start}, 2)) AS INTEGER) ELSE {default} END"


@query("f03_parse_hex_color", f"""
    SELECT o_orderkey, {_hex_part(1, 255)} AS r, {_hex_part(3, 107)} AS g, {_hex_part(5, 107)} AS b
    FROM (SELECT *, ltrim({_COLOR}, '#') AS digits FROM orders)""")
def _(b: Bridge) -> DataFrame:
    return b.table("orders").selectExpr("o_orderkey", f"{_COLOR} AS color").select(
        "o_orderkey", fn.parse_hex_color(F.col("color")).alias("c")
    ).select("o_orderkey", "c.*")


@query("f04_tile_key", oracle("""
    SELECT slide_id, CAST(level AS BIGINT) * 281474976710656 + CAST(col AS BIGINT) * 16777216 + "row" AS tile_key, level, col, "row" FROM b_grid""", "b_grid"))
def _(b: Bridge) -> DataFrame:
    keyed = P.grid(b.levels).select("slide_id", fn.tile_key(F.col("level"), F.col("col"), F.col("row")).alias("tile_key"))
    return keyed.select("slide_id", "tile_key", fn.tile_key_parts(F.col("tile_key")).alias("p")).select(
        "slide_id", "tile_key", "p.*"
    )


@query("f05_slide_id", oracle("""
    SELECT s.path, true AS same_as_upper, lower(s.path) = lower(coalesce(n.path, '')) AS same_as_next
    FROM b_slides s LEFT JOIN b_slides n ON n.slide_id = s.slide_id + 1""", "b_slides"))
def _(b: Bridge) -> DataFrame:
    following = b.slides.select((F.col("slide_id") - 1).alias("slide_id"), F.col("path").alias("_next"))
    own = fn.slide_id(F.col("path"))
    return b.slides.join(following, "slide_id", "left").select(
        "path", (own == fn.slide_id(F.upper("path"))).alias("same_as_upper"),
        (own == fn.slide_id(F.coalesce("_next", F.lit("")))).alias("same_as_next"),
    )
