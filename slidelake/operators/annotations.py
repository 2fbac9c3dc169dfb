"""Vector annotations: normalising, spatial joins, edits, groups and shapes.

An annotation row has ``slide_id, annotation_id, type, coordinates
ARRAY<STRUCT<x, y>>, properties MAP<STRING, STRING>``; all coordinates are
slide px.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.operators.ordering import explode_range, number_rows
from slidelake.operators.quadtree import NODE, PARTS, node_side, spread_crowded
from slidelake.operators.skew import salted_join

BOX = ["min_x", "min_y", "max_x", "max_y"]


def normalize_annotations(df: DataFrame) -> DataFrame:
    """Promote label, color, notes and group out of the properties, with defaults."""
    defaults = {
        "label": S.DEFAULT_LABEL, "color": S.DEFAULT_COLOR, "notes": S.DEFAULT_NOTES, "group": S.DEFAULT_GROUP,
    }
    return df.withColumns(
        {name: F.coalesce(F.col("properties")[name], F.lit(value)) for name, value in defaults.items()}
    )


def with_bounds(df: DataFrame) -> DataFrame:
    """Bounding box of the coordinates; rows without coordinates get zeros."""
    zero = F.lit(0.0)
    xs = F.transform("coordinates", lambda p: p["x"])
    ys = F.transform("coordinates", lambda p: p["y"])
    return df.withColumns(
        {
            "min_x": F.coalesce(F.array_min(xs), zero),
            "min_y": F.coalesce(F.array_min(ys), zero),
            "max_x": F.coalesce(F.array_max(xs), zero),
            "max_y": F.coalesce(F.array_max(ys), zero),
        }
    )


# Cell sides of the spatial grid: 64 px times powers of 2.  A box lives on the
# smallest scale where it is at most 3 cells long, so it touches at most 4 x 4
# cells; boxes beyond the last scale simply cover more of its cells.
_SCALES = 17


def _cell(scale: Column) -> Column:
    return F.lit(64.0) * F.pow(F.lit(2.0), scale)


def _own_scale(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    side = F.greatest(x1 - x0, y1 - y0)
    fitting = F.ceil(F.log2(F.greatest(side, F.lit(192.0)) / F.lit(192.0)))
    return F.least(fitting, F.lit(_SCALES - 1)).cast("int")


def _cells(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Explode the grid cells (``_cx``, ``_cy``) a box covers at its row's ``_scale``."""
    side = _cell(F.col("_scale"))
    spread = df.withColumn(
        "_cx", F.explode(F.sequence(F.floor(F.col(x0) / side), F.floor(F.col(x1) / side)))
    )
    return spread.withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col(y0) / side), F.floor(F.col(y1) / side)))
    )


def query_viewports(annotations: DataFrame, viewports: DataFrame, cell_rows: int = 1 << 16) -> DataFrame:
    """Annotations whose box meets each viewport; touching counts.

    Both sides are laid on grids of several cell sizes and each pair meets on
    the coarser scale of the two, where neither side covers more than a few
    cells.  A side is repeated only on scales the other side really uses; the
    two lists of at most 17 numbers are read first.  Cells with over
    ``cell_rows`` rows of a side are divided by a quadtree.  A pair is kept only
    in the cell holding the low corner of its overlap, which makes it unique
    without a distinct.
    """
    boxes = annotations if set(BOX) <= set(annotations.columns) else with_bounds(annotations)
    boxes = boxes.withColumn("_own", _own_scale(*[F.col(c) for c in BOX]))
    views = viewports.select(
        "viewport_id", "slide_id",
        F.col("x").cast("double").alias("_vx0"), F.col("y").cast("double").alias("_vy0"),
        (F.col("x") + F.col("width")).cast("double").alias("_vx1"),
        (F.col("y") + F.col("height")).cast("double").alias("_vy1"),
    ).filter((F.col("_vx1") >= F.col("_vx0")) & (F.col("_vy1") >= F.col("_vy0")))
    views = views.withColumn("_own", _own_scale(*[F.col(c) for c in ("_vx0", "_vy0", "_vx1", "_vy1")]))
    owns = boxes.select(F.lit(0).alias("side"), "_own").unionAll(views.select(F.lit(1), "_own")).distinct().collect()
    box_scales, view_scales = (sorted(r._own for r in owns if r.side == side and r._own is not None) for side in (0, 1))
    at_own = lambda df: df.withColumn("_scale", F.col("_own"))

    def lifted(df: DataFrame, scales: list[int], own_too: bool) -> DataFrame:
        listed = F.array(*[F.lit(s) for s in scales]).cast("array<int>")
        wanted = F.filter(listed, lambda s: s >= F.col("_own") if own_too else s > F.col("_own"))
        return df.withColumn("_scale", F.explode(wanted))

    view_box = ("_vx0", "_vy0", "_vx1", "_vy1")

    def laid(coarse_view: DataFrame, coarse_box: DataFrame, box: Sequence[str]) -> DataFrame:
        # Kind 0: the box has the coarser scale of the two, or the same; kind 1: the viewport has.
        kinds = [df.withColumn("_kind", F.lit(i)) for i, df in enumerate((coarse_box, coarse_view))]
        return _cells(kinds[0].unionByName(kinds[1]), *box).drop("_own")

    left, right = spread_crowded(
        laid(lifted(boxes, view_scales, False), at_own(boxes), BOX),
        laid(at_own(views), lifted(views, box_scales, True), view_box),
        BOX, view_box, cell_rows,
    )
    return left.join(right, [*NODE, *PARTS]).filter(
        (F.col("min_x") <= F.col("_vx1")) & (F.col("max_x") >= F.col("_vx0"))
        & (F.col("min_y") <= F.col("_vy1")) & (F.col("max_y") >= F.col("_vy0"))
        & (F.floor(F.greatest("min_x", "_vx0") / node_side()) == F.col("_cx"))
        & (F.floor(F.greatest("min_y", "_vy0") / node_side()) == F.col("_cy"))
    ).drop(*[c for c in (*NODE, *PARTS) if c != "slide_id"], *view_box)


def annotations_by_tile(annotations: DataFrame, levels: DataFrame) -> DataFrame:
    """Tiles each annotation's box touches, at every given level.

    Tiles count as closed boxes, as in the range query.
    """
    boxes = annotations if set(BOX) <= set(annotations.columns) else with_bounds(annotations)
    side = (F.col("tile_size").cast("bigint") * F.col("downsample")).cast("double")
    zero = F.lit(0).cast("bigint")

    def first(low: str) -> Column:
        return F.greatest(zero, F.ceil(F.col(low) / side) - 1)

    def last(high: str, count: str) -> Column:
        return F.least(F.col(count).cast("bigint"), F.floor(F.col(high) / side) + 1)

    ranged = salted_join(
        boxes, levels.select("slide_id", "level", "downsample", "cols", "rows", "tile_size"), ["slide_id"]
    ).select(
        *boxes.columns, "level", "downsample", "tile_size",
        first("min_x").alias("_c0"), last("max_x", "cols").alias("_c1"),
        first("min_y").alias("_r0"), last("max_y", "rows").alias("_r1"),
    )
    rows = explode_range(ranged, F.col("_r0"), F.col("_r1"), "row")
    return explode_range(rows, F.col("_c0"), F.col("_c1"), "col").drop("_c0", "_c1", "_r0", "_r1")


def annotation_groups(df: DataFrame) -> DataFrame:
    """Group names with their counts, ordered by slide and name."""
    return df.groupBy("slide_id", "group").agg(F.count(F.lit(1)).alias("n")).orderBy("slide_id", "group")


def by_group(df: DataFrame, group: str) -> DataFrame:
    return df.filter(F.col("group") == group)


def by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("slide_id", "annotation_id"), ["slide_id", "annotation_id"], "left_semi")


def max_id_number(existing: DataFrame) -> DataFrame:
    """Largest numeric suffix of ``ann_`` ids per slide."""
    number = F.regexp_extract("annotation_id", r"^ann_([0-9]+)$", 1).try_cast("bigint")
    return existing.groupBy("slide_id").agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))


def append_batch(existing: DataFrame, batch: DataFrame, group: str, order: str = "seq") -> DataFrame:
    """Append a batch under one group with ids continuing after the largest number.

    Rows without coordinates are skipped; a missing type means polygon.  Numbers
    come from per-partition counts, so even one slide's batch is numbered by
    many tasks.
    """
    usable = batch.filter(F.size(F.coalesce("coordinates", F.array().cast(S.POINTS))) > 0)
    numbered = number_rows(usable, ["slide_id"], [order], "_n")
    new = salted_join(numbered, max_id_number(existing), ["slide_id"], "left").select(
        "slide_id",
        F.format_string("ann_%06d", F.col("_n") + F.coalesce("_last", F.lit(0).cast("bigint"))).alias("annotation_id"),
        F.coalesce("type", F.lit("polygon")).alias("type"),
        "coordinates",
        F.create_map(
            F.lit("label"), F.coalesce("label", F.lit(S.DEFAULT_LABEL)),
            F.lit("color"), F.coalesce("color", F.lit(S.DEFAULT_COLOR)),
            F.lit("group"), F.lit(group),
        ).alias("properties"),
    )
    return existing.select(*new.columns).unionByName(new)


def remove(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Annotations without those listed; unknown ids are ignored."""
    return df.join(ids.select("slide_id", "annotation_id"), ["slide_id", "annotation_id"], "left_anti")


def removed_count(df: DataFrame, ids: DataFrame) -> DataFrame:
    """How many annotations of each slide a removal takes away."""
    return by_id(df, ids).groupBy("slide_id").agg(F.count(F.lit(1)).alias("removed"))


def remove_group(df: DataFrame, group: str) -> DataFrame:
    return df.filter(~(F.col("group") == group))


def removed_group_count(df: DataFrame, group: str) -> DataFrame:
    return by_group(df, group).groupBy("slide_id").agg(F.count(F.lit(1)).alias("removed"))


# --- edit log -------------------------------------------------------------
# A change row is (slide_id, seq, op, annotation_id, group, type, coordinates,
# label, color) with op one of: add, set_coordinates, set_style, delete,
# delete_group, clear.  Every entity an edit can hit folds to a few maxima, so
# the log combines before the shuffle and needs no ordering window; the same
# fold works as a streaming aggregate.

def change_entities(changes: DataFrame) -> DataFrame:
    """Tag each change with the entity it acts on: annotation, group or slide."""
    on_group, on_slide = F.col("op") == "delete_group", F.col("op") == "clear"
    return changes.withColumn(
        "entity", F.when(on_slide, "slide").when(on_group, "group").otherwise("annotation")
    ).withColumn(
        "entity_key",
        F.when(on_slide, F.lit("")).when(on_group, F.col("group")).otherwise(F.col("annotation_id")),
    )


def fold_changes(entities: DataFrame) -> DataFrame:
    """Fold tagged changes to one state row per entity (batch or streaming)."""
    op = F.col("op")

    def latest(name: str, kind: str, *cols: str) -> Column:
        return F.max_by(
            F.when(op == kind, F.struct("seq", *cols)), F.when(op == kind, F.col("seq"))
        ).alias(name)

    return entities.groupBy("slide_id", "entity", "entity_key").agg(
        F.min_by(
            F.when(op == "add", F.struct("seq", "group", "type", "coordinates", "label", "color")),
            F.when(op == "add", F.col("seq")),
        ).alias("created"),
        latest("moved", "set_coordinates", "coordinates"),
        latest("styled", "set_style", "label", "color"),
        F.max(F.when(op.isin("delete", "delete_group", "clear"), F.col("seq"))).alias("removed_seq"),
    )


def _effective(changes: DataFrame) -> DataFrame:
    return changes.filter((F.col("op") != "add") | (F.size("coordinates") > 0))


def fold_log(changes: DataFrame) -> DataFrame:
    """Fold an edit log; additions without coordinates are left out."""
    return fold_changes(change_entities(_effective(changes)))


def merge_folds(folds: DataFrame) -> DataFrame:
    """One state row per entity from the folds of several parts of a log, in any order and with repeats.

    What a removal has ended for good keeps its numbers, without coordinates and edits.
    """
    first = lambda c: F.min_by(c, F.col(f"{c}.seq")).alias(c)
    last = lambda c: F.max_by(c, F.col(f"{c}.seq")).alias(c)
    merged = folds.groupBy("slide_id", "entity", "entity_key").agg(
        first("created"), last("moved"), last("styled"), F.max("removed_seq").alias("removed_seq")
    )
    ended = F.coalesce(F.col("removed_seq") > F.col("created.seq"), F.lit(False))
    nothing = F.lit(None).cast(folds.schema["created"].dataType["coordinates"].dataType)
    return merged.select(
        "slide_id", "entity", "entity_key",
        F.when(ended, F.col("created").withField("coordinates", nothing)).otherwise(F.col("created")).alias("created"),
        F.when(~ended, F.col("moved")).alias("moved"), F.when(~ended, F.col("styled")).alias("styled"), "removed_seq",
    )


def resolve_state(state: DataFrame) -> DataFrame:
    """Live annotations from folded state rows.

    A removal counts only after the creation; edits before the creation are
    no-ops.  The group stays the one given at creation.
    """
    items = state.filter((F.col("entity") == "annotation") & F.col("created").isNotNull()).select(
        "slide_id", F.col("entity_key").alias("annotation_id"), F.col("created.group").alias("group"),
        "created", "moved", "styled", "removed_seq",
    )
    groups = state.filter(F.col("entity") == "group").select(
        "slide_id", F.col("entity_key").alias("group"), F.col("removed_seq").alias("group_seq")
    )
    slides = state.filter(F.col("entity") == "slide").select(
        "slide_id", F.col("removed_seq").alias("clear_seq")
    )
    born = F.col("created.seq")
    latest_removal = F.greatest("removed_seq", "group_seq", "clear_seq")
    alive = salted_join(
        salted_join(items, groups, ["slide_id", "group"], "left"), slides, ["slide_id"], "left"
    ).filter(
        ~F.coalesce(latest_removal > born, F.lit(False))
    )
    moved, styled = F.col("moved.seq") > born, F.col("styled.seq") > born
    return alive.select(
        "slide_id", "annotation_id", F.col("created.type").alias("type"), "group",
        F.when(moved, F.col("moved.coordinates")).otherwise(F.col("created.coordinates")).alias("coordinates"),
        F.when(styled, F.col("styled.label")).otherwise(F.col("created.label")).alias("label"),
        F.when(styled, F.col("styled.color")).otherwise(F.col("created.color")).alias("color"),
    )


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Current annotations after an edit log; ``base`` counts as added before it."""
    first = base.select(
        "slide_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("add").alias("op"), "annotation_id",
        "group", "type", "coordinates", "label", "color",
    )
    return resolve_state(fold_changes(change_entities(first.unionByName(_effective(changes)))))


def replace_all(loaded: DataFrame, position: str = "pos") -> DataFrame:
    """Whole-set replacement on load; the last of several equal ids wins."""
    others = [c for c in loaded.columns if c not in ("slide_id", "annotation_id")]
    return loaded.groupBy("slide_id", "annotation_id").agg(
        F.max_by(F.struct(*others), position).alias("_last")
    ).select("slide_id", "annotation_id", "_last.*")


def known_labels() -> list[str]:
    return [label for label, _ in S.CELL_TYPES.values()]


def label_counts(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Count per known label and slide, zero-filled; other labels are ignored."""
    labels = labels or known_labels()
    wide = df.groupBy("slide_id").agg(
        *[F.count_if(F.col("label") == label).alias(f"_n{i}") for i, label in enumerate(labels)]
    )
    pairs = [F.struct(F.lit(label).alias("label"), F.col(f"_n{i}").alias("n")) for i, label in enumerate(labels)]
    return wide.select("slide_id", F.inline(F.array(*pairs)))


def filter_visible(df: DataFrame, visibility: DataFrame) -> DataFrame:
    """Hide only labels explicitly switched off."""
    return (
        df.join(visibility.select("label", F.col("visible").alias("_visible")), "label", "left")
        .filter(F.coalesce(F.col("_visible"), F.lit(True)))
        .drop("_visible")
    )


# --- drawn shapes ---------------------------------------------------------

def accept_shapes(df: DataFrame, min_side: float = 10.0, min_points: int = 2) -> DataFrame:
    """Accept drawn shapes given in screen px and convert them to slide px.

    Rectangles get ordered corners and need both sides of at least 10 slide px;
    freehand lines need two points.
    """
    scaled = df.withColumn(
        "coordinates",
        F.transform(
            "coordinates", lambda p: F.struct((p["x"] / F.col("scale")).alias("x"), (p["y"] / F.col("scale")).alias("y"))
        ),
    )
    a, b = F.get("coordinates", 0), F.get("coordinates", 1)
    corners = F.array(
        F.struct(F.least(a["x"], b["x"]).alias("x"), F.least(a["y"], b["y"]).alias("y")),
        F.struct(F.greatest(a["x"], b["x"]).alias("x"), F.greatest(a["y"], b["y"]).alias("y")),
    )
    wide = (F.abs(a["x"] - b["x"]) >= min_side) & (F.abs(a["y"] - b["y"]) >= min_side)
    keep = (
        F.when(F.col("type") == "rectangle", (F.size("coordinates") >= 2) & wide)
        .when(F.col("type") == "freehand", F.size("coordinates") >= min_points)
        .otherwise(F.size("coordinates") > 0)
    )
    return scaled.filter(keep).withColumn(
        "coordinates", F.when(F.col("type") == "rectangle", corners).otherwise(F.col("coordinates"))
    )


def decimate(df: DataFrame, min_distance: float = 2.0) -> DataFrame:
    """Keep a point only if it is far enough from the last kept one."""
    limit = F.lit(min_distance * min_distance)

    def step(kept: Column, point: Column) -> Column:
        last = F.element_at(kept, -1)
        dx, dy = point["x"] - last["x"], point["y"] - last["y"]
        return F.when((F.size(kept) == 0) | (dx * dx + dy * dy >= limit), F.concat(kept, F.array(point))).otherwise(kept)

    # try_element_at would return null on an empty array; the fold starts with the first point instead.
    first = F.slice("coordinates", 1, 1)
    rest = F.slice("coordinates", F.lit(2), F.greatest(F.size("coordinates") - 1, F.lit(0)))
    return df.withColumn(
        "coordinates",
        F.when(F.size("coordinates") <= 1, F.col("coordinates")).otherwise(F.aggregate(rest, first, step)),
    )


def measure(df: DataFrame) -> DataFrame:
    """Distance in slide px between two screen points."""
    dx = (F.col("end_x") - F.col("start_x")) / F.col("scale")
    dy = (F.col("end_y") - F.col("start_y")) / F.col("scale")
    return df.withColumn("distance", F.hypot(dx, dy))


# --- analysis features ----------------------------------------------------

def type_color(label: Column) -> Column:
    """Colour of a known cell type, else null."""
    color = F.lit(None).cast("string")
    for known, value in S.CELL_TYPES.values():
        color = F.when(label == known, F.lit(value)).otherwise(color)
    return color


def flatten_features(df: DataFrame) -> DataFrame:
    """Features with geometry to annotation rows with label and colour fallbacks.

    ``geometry STRUCT<type, coordinates>`` and ``properties`` may be null; rows
    without coordinates are dropped, empty texts count as missing.
    """
    def text(name: str) -> Column:
        return F.nullif(F.col("properties")[name], F.lit(""))

    label = F.coalesce(text("label"), F.lit(S.UNKNOWN_LABEL))
    return df.filter(F.size(F.coalesce("geometry.coordinates", F.array().cast(S.POINTS))) > 0).select(
        *[c for c in df.columns if c not in ("geometry", "properties")],
        F.col("geometry.type").alias("type"),
        F.col("geometry.coordinates").alias("coordinates"),
        label.alias("label"),
        F.coalesce(text("color"), type_color(label), F.lit(S.UNKNOWN_COLOR)).alias("color"),
    )


def feature_breakdown(flat: DataFrame) -> DataFrame:
    """Number of flattened features per slide and label."""
    return flat.groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("n"))
