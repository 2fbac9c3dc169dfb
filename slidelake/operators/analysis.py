"""Running user analyses and the built-in colour and tissue analyses."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slidelake import schema as S
from slidelake.operators.annotations import append_batch
from slidelake.operators.grouping import map_sorted_groups, partitions_of
from slidelake.operators.levels import level_for_mpp
from slidelake.operators.skew import HASHABLE
from slidelake.sources.tilestore import wanted_tiles

INPUT_KINDS = ("tile", "region", "whole_slide", "annotations")
# Fixed values of the tissue rules.
TISSUE_MPP = 8.0
TISSUE_THRESHOLD = 0.15
CHANNELS = ("red", "green", "blue")


@dataclass(frozen=True)
class ModelSpec:
    """A model that is loaded once per task, used for all its rows, then released."""

    load: Callable[[], Any]
    predict: Callable[[Any, pd.DataFrame], dict]
    unload: Callable[[Any], None] | None = None


@dataclass(frozen=True)
class AnalysisSpec:
    """What an analysis needs and how it runs.

    For tiles and regions ``process`` gets one row's data frame and returns a
    dict of output columns; a ``model`` replaces it for model-backed analyses.

    For whole slides and annotation sets ``process`` gets an iterator over the
    group's rows, so a slide is read as a stream and never held.  With a
    ``merge`` the group is split over many tasks: ``process`` then returns a
    small partial state for its share, and ``merge`` turns the list of states
    into the output dict.
    """

    name: str
    output_schema: str
    process: Callable[[Any], Any] | None = None
    merge: Callable[[list], dict] | None = None
    model: ModelSpec | None = None
    input_kind: str = "region"
    input_size: tuple[int, int] | None = None
    working_mpp: float = S.TARGET_MPP
    context_mpp: float | None = None
    keys: tuple[str, ...] = ("request_id",)
    labels: tuple[str, ...] = field(default_factory=tuple)


def input_problem(spec: AnalysisSpec) -> Column:
    """Why an image row is no input of the analysis; empty if it is one."""
    pixels = F.col("width").cast("bigint") * F.col("height") * 3
    shaped = (F.col("width") > 0) & (F.col("height") > 0) & (F.length("rgb") == pixels)
    message = F.when(~F.coalesce(shaped, F.lit(False)), "Expected RGB image with 3 channels")
    if spec.input_size:
        h, w = spec.input_size
        message = message.when(
            (F.col("height") != h) | (F.col("width") != w), f"Expected input size {h}x{w}"
        )
    return F.coalesce(message, F.lit(""))


def validate_inputs(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Add ``valid`` and ``message``: three-channel pixels of the expected size."""
    return df.withColumn("message", input_problem(spec)).withColumn("valid", F.col("message") == "")


def run_analysis(spec: AnalysisSpec, inputs: DataFrame) -> DataFrame:
    """Run an analysis over all rows or groups of the inputs.

    Output: the key columns, ``success, message, processing_time`` and the
    columns of ``output_schema``.  An exception makes its own row fail and
    leaves the others alone; so does an image that ``validate_inputs`` refuses.
    """
    if spec.input_kind not in INPUT_KINDS:
        raise ValueError(f"unknown input kind {spec.input_kind}")
    keys = list(spec.keys)
    key_schema = ", ".join(f"`{k}` {inputs.schema[k].dataType.simpleString()}" for k in keys)
    outputs = [part.split()[0] for part in _split_schema(spec.output_schema)]
    schema = f"{key_schema}, success boolean, message string, processing_time double, {spec.output_schema}"
    names = [*keys, "success", "message", "processing_time", *outputs]

    def one(key: tuple, rows: pd.DataFrame, call: Callable[[pd.DataFrame], dict]) -> list:
        started = time.perf_counter()
        try:
            result, message, success = call(rows), "", True
        except Exception as error:  # a failed row, not a failed job
            result, message, success = {}, str(error), False
        return [*key, success, message, time.perf_counter() - started, *[result.get(c) for c in outputs]]

    def refuse(problem: str) -> Callable:
        def fail(_rows):
            raise ValueError(problem)

        return fail

    def over_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = spec.model.load() if spec.model else None
        call = (lambda rows: spec.model.predict(model, rows)) if spec.model else spec.process
        try:
            for pdf in batches:
                problems = pdf.pop("_problem")
                done = [
                    one(tuple(pdf[k].iloc[i] for k in keys), pdf.iloc[i:i + 1], refuse(problem) if problem else call)
                    for i, problem in enumerate(problems)
                ]
                yield pd.DataFrame(done, columns=names).astype(object)
        finally:
            if spec.model and spec.model.unload:
                spec.model.unload(model)

    if spec.input_kind in ("tile", "region"):
        if {"width", "height", "rgb"} <= set(inputs.columns):
            inputs = inputs.withColumn("_problem", input_problem(spec))
        else:
            inputs = inputs.withColumn("_problem", F.lit(""))
        return inputs.mapInPandas(over_rows, schema)
    if spec.model:
        raise ValueError("models run on tiles and regions; combine their results per slide")

    def whole(key: tuple, rows: Iterator) -> Iterator[tuple]:
        yield tuple(one(key, rows, spec.process))

    if spec.merge is None:
        return map_sorted_groups(inputs, keys, [], whole, schema, names)

    shares = min(256, partitions_of(inputs))
    spread = [f.name for f in inputs.schema.fields if f.name not in keys and isinstance(f.dataType, HASHABLE)]
    share = F.pmod(F.xxhash64(*spread), F.lit(shares)).cast("int") if spread else F.lit(0)

    def partial(key: tuple, rows: Iterator) -> Iterator[tuple]:
        started = time.perf_counter()
        try:
            state, message = pickle.dumps(spec.process(rows)), None
        except Exception as error:
            state, message = None, str(error)
        yield (*key, state, message, time.perf_counter() - started)

    def combine(key: tuple, rows: Iterator) -> Iterator[tuple]:
        parts = list(rows)  # at most one small state per share
        errors = [p.error for p in parts if p.error is not None]
        spent = sum(p.seconds for p in parts)

        def merged(states: list) -> dict:
            if errors:
                raise RuntimeError(errors[0])
            return spec.merge(states)

        made = one(key, [pickle.loads(p.state) for p in parts if p.state is not None], merged)
        made[len(key) + 2] += spent
        yield tuple(made)

    states = map_sorted_groups(
        inputs.withColumn("_share", share), [*keys, "_share"], [], partial,
        f"{key_schema}, _share int, state binary, error string, seconds double",
        [*keys, "_share", "state", "error", "seconds"],
    )
    return map_sorted_groups(states.drop("_share"), keys, [], combine, schema, names)


def _split_schema(text: str) -> list[str]:
    """Top-level fields of a DDL string (commas inside brackets do not split)."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


# --- pixel moments --------------------------------------------------------

def image_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact integer sums per image row: n, per channel sum and square sum, gray sums."""
    names = [*keys, "n"]
    for c in ("r", "g", "b", "gray"):
        names += [f"s_{c}", f"q_{c}"]
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                px = np.frombuffer(row[-1], np.uint8).reshape(-1, 3).astype(np.int64)
                line = [*row[:-1], len(px)]
                for values in (px[:, 0], px[:, 1], px[:, 2], px.sum(axis=1)):
                    line += [int(values.sum()), int((values * values).sum())]
                out.append(line)
            yield pd.DataFrame(out, columns=names)

    fields = ", ".join(f"{n} bigint" for n in names[len(keys):])
    return df.select(*keys, "rgb").mapInPandas(sums, f"{key_schema}, {fields}")


# --- tissue ---------------------------------------------------------------

def tissue_scores(tiles: DataFrame, levels: DataFrame, mpp: float = TISSUE_MPP) -> DataFrame:
    """Darkness score of each stored tile at the level for the given resolution.

    ``levels`` carries ``mpp``.  The level is chosen per slide first, so only
    that level's pixels are read.
    """
    chosen = _chosen_levels(levels, mpp)
    keys = ["slide_id", "level", "col", "row"]
    used = wanted_tiles(tiles, chosen, ["slide_id", "level"])
    s = image_moments(used, keys)
    return s.select(
        *keys,
        F.greatest(F.lit(0.0), 1 - F.col("s_gray") / (F.col("n") * 3) / 255.0).alias("score"),
    )


def _chosen_levels(levels: DataFrame, mpp: float) -> DataFrame:
    wanted = levels.select("slide_id").distinct().withColumn("target_mpp", F.lit(float(mpp)))
    return level_for_mpp(wanted, levels).select("slide_id", "tile_size", "level_info.*")


def tissue_summary(scores: DataFrame, levels: DataFrame, mpp: float = TISSUE_MPP,
                   threshold: float = TISSUE_THRESHOLD) -> DataFrame:
    """Tissue tiles, grid tiles and their ratio per slide; missing tiles are no tissue."""
    found = scores.groupBy("slide_id").agg(F.count_if(F.col("score") > threshold).alias("tissue_tiles"))
    total = _chosen_levels(levels, mpp).select(
        "slide_id", "level", (F.col("cols").cast("bigint") * F.col("rows")).alias("total_tiles")
    )
    return total.join(found, "slide_id", "left").withColumn(
        "tissue_tiles", F.coalesce("tissue_tiles", F.lit(0).cast("bigint"))
    ).withColumn("tissue_fraction", F.col("tissue_tiles") / F.greatest("total_tiles", F.lit(1)))


def score_grid(scores: DataFrame, levels: DataFrame, mpp: float = TISSUE_MPP) -> DataFrame:
    """Dense score grid, one row per grid row with its scores in column order.

    A grid row has at most 65535 columns, which bounds every group.
    """
    chosen = _chosen_levels(levels, mpp)
    lines = scores.groupBy("slide_id", "level", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "score"))).alias("by_col")
    )
    frame = chosen.select(
        "slide_id", "level", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.col("cols") - 1),
        lambda c: F.coalesce(F.element_at("by_col", c), F.lit(0.0)),
    )
    return frame.join(lines, ["slide_id", "level", "row"], "left").select(
        "slide_id", "level", "row", filled.alias("scores")
    )


def classify_regions(regions: DataFrame) -> DataFrame:
    """Label, confidence, probabilities and statistics of each region's colours.

    Regions may come in several blocks per ``request_id``; integer sums are
    added, so the result is exact.
    """
    s = _merged_sums(regions)
    n = F.col("n")
    mean = {c: F.col(f"s_{c}") / n / 255.0 for c in "rgb"}
    std = {c: _pop_std(c, n) / 255.0 for c in "rgb"}
    base = s.select(
        "request_id",
        *[mean[c].alias(f"mean_{c}") for c in "rgb"],
        *[std[c].alias(f"std_{c}") for c in "rgb"],
    )
    stats = base.withColumn(
        "brightness", (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3
    ).withColumn("saturation", (F.col("std_r") + F.col("std_g") + F.col("std_b")) / 3)
    b, s_ = F.col("brightness"), F.col("saturation")
    rules: list[tuple[Column, str, Column]] = [
        (b > 0.9, "Background", F.least(F.lit(0.95), b)),
        (b < 0.3, "Artifact", F.lit(0.7)),
        ((F.col("mean_r") > F.col("mean_b")) & (s_ > 0.15), "Dense Tissue", F.lit(0.8)),
        ((F.col("mean_r") > F.col("mean_b")) & (s_ > 0.1), "Tissue", F.lit(0.75)),
    ]
    label, confidence = F.lit("Tissue"), F.lit(0.6)
    for test, name, value in reversed(rules):
        label = F.when(test, F.lit(name)).otherwise(label)
        confidence = F.when(test, value).otherwise(confidence)
    return (
        stats.withColumn("label", label)
        .withColumn("confidence", confidence)
        .withColumn("p_background", F.when(b > 0.8, 1.0 - s_).otherwise(F.lit(0.1)))
        .withColumn("p_tissue", F.when(F.col("label") == "Tissue", 0.5).otherwise(0.2))
        .withColumn("p_dense_tissue", F.when(F.col("label") == "Dense Tissue", 0.3).otherwise(0.1))
        .withColumn("p_artifact", F.when(b < 0.4, 0.1).otherwise(0.05))
    )


def _merged_sums(regions: DataFrame) -> DataFrame:
    sums = image_moments(regions, ["request_id"])
    return sums.groupBy("request_id").agg(*[F.sum(c).alias(c) for c in sums.columns if c != "request_id"])


def _pop_std(channel: str, n: Column) -> Column:
    """Population standard deviation from integer sums, in exact arithmetic up to the root."""
    s, q = F.col(f"s_{channel}").cast("decimal(38,0)"), F.col(f"q_{channel}").cast("decimal(38,0)")
    spread = (q * n.cast("decimal(19,0)") - s * s).cast("double")
    return F.sqrt(F.greatest(spread, F.lit(0.0))) / n


def color_stats(regions: DataFrame) -> DataFrame:
    """Mean, deviation, extremes and median per channel, gray statistics and size.

    The pixels are read once: every block becomes a histogram of at most 256
    values per channel and of the sums of the three, beside its size.  The
    histograms add up across blocks, so all figures are exact and a region of any
    size is never sorted.
    """
    kinds = np.array([*CHANNELS, "gray", "size"], object)
    rid = regions.schema["request_id"].dataType.simpleString()

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, channel, value, count = [], [], [], []
            for place, (width, height, rgb) in enumerate(zip(pdf.width, pdf.height, pdf.rgb)):
                px = np.frombuffer(rgb, np.uint8).reshape(-1, 3)
                told = [*(np.bincount(px[:, i]) for i in range(3)), np.bincount(px.sum(axis=1, dtype=np.int64))]
                values = [np.flatnonzero(t) for t in told]
                told = [t[v] for t, v in zip(told, values)]
                if not pd.isna(width) and not pd.isna(height):
                    values.append(np.array([width], np.int64))
                    told.append(np.array([height], np.int64))
                sizes = [len(v) for v in values]
                owner.append(np.full(sum(sizes), place))
                channel.append(np.repeat(np.arange(len(sizes)), sizes))
                value += values
                count += told
            if owner:
                yield pd.DataFrame({
                    "request_id": pdf.request_id.to_numpy()[np.concatenate(owner)], "channel": kinds[np.concatenate(channel)],
                    "value": np.concatenate(value), "n": np.concatenate(count),
                })

    counts = (
        regions.select("request_id", "width", "height", "rgb")
        .mapInPandas(histogram, f"request_id {rid}, channel string, value bigint, n bigint")
        .groupBy("request_id", "channel", "value").agg(F.sum("n").alias("n"))
    )
    per_channel = Window.partitionBy("request_id", "channel")
    ranked = counts.withColumn("upto", F.sum("n").over(per_channel.orderBy("value"))).withColumn("total", F.sum("n").over(per_channel))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    value, count, n = F.col("value"), F.col("n"), F.col("pixels")

    def of(channel: str, what: Column, *also: Column) -> Column:
        where = F.col("channel") == channel
        for condition in also:
            where = where & condition
        return F.when(where, what)

    figures, extremes = [], []
    for short, channel in (*zip("rgb", CHANNELS), ("gray", "gray")):
        figures += [F.sum(of(channel, value * count)).alias(f"s_{short}"), F.sum(of(channel, value * value * count)).alias(f"q_{short}")]
    for channel in CHANNELS:
        middle = [F.min(of(channel, value, F.col("upto") > place)) for place in (low, high)]
        extremes += [
            F.min(of(channel, value)).cast("int").alias(f"{channel}_min"), F.max(of(channel, value)).cast("int").alias(f"{channel}_max"),
            ((middle[0] + middle[1]) / 2).alias(f"{channel}_median"),
        ]
    merged = ranked.groupBy("request_id").agg(
        *figures, *extremes, F.sum(of("gray", count)).alias("pixels"),
        F.max(of("size", value)).cast("int").alias("width"), F.sum(of("size", count)).cast("int").alias("height"),
    ).filter(n > 0)
    return merged.select(
        "request_id",
        *[(F.col(f"s_{c}") / n).alias(f"{name}_mean") for c, name in zip("rgb", CHANNELS)],
        *[_pop_std(c, n).alias(f"{name}_std") for c, name in zip("rgb", CHANNELS)],
        (F.col("s_gray") / n / 3).alias("gray_mean"),
        (_pop_std("gray", n) / 3).alias("gray_std"),
        "pixels",
        *[f"{c}_{figure}" for c in CHANNELS for figure in ("min", "max", "median")],
        "width", "height",
    )


# --- outputs --------------------------------------------------------------

# Fixed order in which an output's kind is decided.
OUTPUT_PRECEDENCE = ["classification", "tile_scores", "measurements", "annotations", "mask", "heatmap", "image"]


def with_output_type(df: DataFrame) -> DataFrame:
    """Primary kind of each output and flags for the raster kinds."""
    kind = F.lit("classification")
    for name in reversed(OUTPUT_PRECEDENCE):
        if name in df.columns:
            kind = F.when(F.col(name).isNotNull(), F.lit(name)).otherwise(kind)
    flags = {
        f"has_{name}": (F.col(name).isNotNull() if name in df.columns else F.lit(False))
        for name in ("mask", "heatmap", "image", "tile_scores")
    }
    return df.withColumn("output_type", kind).withColumns(flags)


def is_flat(annotations: Column) -> Column:
    """Whether the first telling record of an output is a plain annotation.

    Records with a geometry are features, records with coordinates are plain;
    records with neither do not decide.
    """
    telling = F.filter(annotations, lambda a: a["geometry"].isNotNull() | a["coordinates"].isNotNull())
    return F.coalesce(F.get(telling, 0)["geometry"].isNull() & (F.size(telling) > 0), F.lit(False))


def routable(outputs: DataFrame) -> DataFrame:
    """Flat annotation records of successful outputs, one row each."""
    usable = outputs.filter(
        F.col("success") & (F.size(F.coalesce("annotations", F.array())) > 0) & is_flat(F.col("annotations"))
    )
    return usable.select("slide_id", "output_id", F.posexplode("annotations").alias("pos", "a")).select(
        "slide_id", "output_id", "pos", "a.type", "a.coordinates", "a.label", "a.color"
    )


def route_annotations(outputs: DataFrame, annotations: DataFrame, analysis_name: str) -> DataFrame:
    """Append flat annotation outputs to the annotation table under the analysis name."""
    batch = routable(outputs).withColumn("seq", F.struct("output_id", "pos"))
    return append_batch(annotations, batch, analysis_name or "plugin")


def breakdown(outputs: DataFrame) -> DataFrame:
    """Counts per output and label: a reported count map, else counted by label.

    The first present of ``counts_by_type, type_counts, counts`` wins.
    """
    reported = F.coalesce("measurements.counts_by_type", "measurements.type_counts", "measurements.counts")
    given = outputs.filter(reported.isNotNull()).select(
        "output_id", F.explode(reported).alias("label", "n")
    ).select("output_id", "label", F.col("n").cast("bigint").alias("n"))
    label = F.coalesce(F.nullif(F.col("a.label"), F.lit("")), F.lit(S.UNKNOWN_LABEL))
    counted = (
        outputs.filter(reported.isNull())
        .select("output_id", F.explode("annotations").alias("a"))
        .groupBy("output_id", label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return given.unionByName(counted)


def breakdown_totals(outputs: DataFrame) -> DataFrame:
    """Total per output: the breakdown's sum, or the record count when it is empty."""
    summed = breakdown(outputs).groupBy("output_id").agg(F.sum("n").alias("total"))
    return outputs.select(
        "output_id", F.size(F.coalesce("annotations", F.array())).cast("bigint").alias("_size")
    ).join(summed, "output_id", "left").select("output_id", F.coalesce("total", "_size").alias("total"))
