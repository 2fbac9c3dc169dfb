"""GeoJSON annotation documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.operators.ordering import number_rows
from slidelake.operators.skew import salted_join
from slidelake.session import cut_lineage
from slidelake.sources.jsonscan import array_elements

_PAIR = "array<double>"


def _points(rings: Column) -> Column:
    """Array of coordinate pairs to an array of points."""
    return F.transform(rings, lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y")))


def _once(df: DataFrame, name: str, **fields: Column) -> DataFrame:
    """Add a struct of fields by exploding a one-element array.

    Plain columns would be copied into every expression and filter above them, and
    a feature's text would be parsed some dozens of times.
    """
    made = F.struct(*[column.alias(field) for field, column in fields.items()])
    return df.select("*", F.explode(F.array(made)).alias(name))


def parse_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, slide_id, document)`` to ``(annotations, rejects)``.

    A document that is no JSON or has no ``features`` is rejected as a whole; a
    bad feature is rejected alone.  A feature without id gets one made of its path and
    position, the same at every read.
    """
    keys = F.json_object_keys("document")
    listed = documents.withColumn(
        "reason",
        F.when(keys.isNull(), F.lit("malformed JSON")).when(
            ~F.array_contains(keys, "features"), F.lit("missing features")
        ),
    )
    texts = F.from_json(F.get_json_object("document", "$.features"), "array<string>")
    # A part says how many features of its slide came before it.
    first = F.coalesce(F.get_json_object("document", "$.first_position").try_cast("int"), F.lit(0))
    features = listed.filter(F.col("reason").isNull()).select(
        "path", "slide_id", first.alias("first"), F.posexplode(texts).alias("pos", "feature")
    ).withColumn("pos", F.col("first") + F.col("pos")).drop("first")
    annotations, bad = parse_features(features)
    return annotations, listed.filter(F.col("reason").isNotNull()).select(
        "path", "slide_id", F.lit(None).cast("int").alias("pos"), "reason"
    ).unionByName(bad)


def parse_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, slide_id, pos, feature)`` to ``(annotations, rejects)``, one feature's text a row."""
    field = lambda name: F.get_json_object("feature", name)
    read = _once(
        features, "read", kind=field("$.type"), id=field("$.id"), shape=field("$.geometry"),
        shape_type=F.coalesce(field("$.geometry.type"), F.lit("")), coordinates=field("$.geometry.coordinates"),
        properties=field("$.properties"),
    )
    coordinates = F.col("read.coordinates")
    absent = coordinates.isNull()
    is_point, is_polygon = F.col("read.shape_type") == "Point", F.col("read.shape_type") == "Polygon"
    # Only what the geometry asks for is parsed.
    parsed = _once(
        read, "parsed",
        properties=F.coalesce(F.from_json("read.properties", "map<string,string>"), F.create_map().cast("map<string,string>")),
        point=F.when(is_point, F.when(absent, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.from_json(coordinates, _PAIR))),
        ring=F.when(is_polygon, F.when(absent, F.array().cast(f"array<{_PAIR}>")).otherwise(
            F.get(F.from_json(coordinates, f"array<array<{_PAIR}>>"), 0)
        )),
    )
    ring = F.col("parsed.ring")
    opened = F.when(
        (F.size(ring) > 1) & (F.get(ring, 0) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)
    ).otherwise(ring)
    kind = F.col("parsed.properties")["annotation_type"]
    pairs = F.when(is_point, F.array("parsed.point")).when(is_polygon, opened).otherwise(
        F.array().cast(f"array<{_PAIR}>")
    )
    shaped = _once(parsed, "shaped", pairs=pairs).withColumn("pairs", F.col("shaped.pairs")).withColumn(
        "reason",
        F.when(F.col("read.kind").isNull() & F.col("read.shape").isNull() & F.col("read.properties").isNull()
               & F.json_object_keys("feature").isNull(), F.lit("feature is no object"))
        .when(
            F.col("pairs").isNull() | F.exists("pairs", lambda p: F.coalesce(F.size(p), F.lit(0)) < 2)
            | F.exists("pairs", lambda p: F.get(p, 0).isNull() | F.get(p, 1).isNull()),
            F.lit("bad coordinates"),
        ),
    )
    good = shaped.filter(F.col("reason").isNull())
    is_rectangle = is_polygon & (kind == "rectangle")
    corners = F.when(
        is_rectangle & (F.size("pairs") >= 4), F.array(F.get("pairs", 0), F.get("pairs", 2))
    ).otherwise(F.col("pairs"))
    digest = F.md5(F.concat_ws(":", "path", F.col("pos").cast("string")))
    made_id = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    annotations = good.select(
        "slide_id", "pos",
        F.coalesce("read.id", made_id).alias("annotation_id"),
        F.when(is_point, "point").when(is_rectangle, "rectangle")
        .when(is_polygon & (kind == "freehand"), "freehand").otherwise("polygon").alias("type"),
        _points(corners).alias("coordinates"),
        F.map_filter("parsed.properties", lambda k, _: k != "annotation_type").alias("properties"),
    )
    return annotations, shaped.filter(F.col("reason").isNotNull()).select("path", "slide_id", "pos", "reason")


def read_annotations(spark: SparkSession, path: str, split_bytes: int = 64 << 20, chunk_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Read annotation documents; the slide is named by the folder (``slide_id=...``) or file stem.

    Files above ``split_bytes`` are cut at feature borders and read by several
    tasks; positions and ids are those of the whole document.  There, brackets decide whether the
    document is malformed, and text that is no JSON inside them rejects its feature alone.
    """
    size, name = F.col("_metadata.file_size"), F.col("_metadata.file_path").alias("path")
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).filter(size <= split_bytes)
    annotations, rejects = parse_documents(whole.select(name, F.col("value").alias("document")).withColumn("slide_id", _slide()))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > split_bytes)
    big = cut_lineage(listed.select(F.col("path").alias("file"), "length", name))
    if big.isEmpty():
        return annotations, rejects
    elements, broken = array_elements(big.select(F.col("file").alias("path"), "length"), "features", "first_position", chunk_bytes)
    named = lambda df: df.withColumnRenamed("path", "file").join(big.select("file", "path"), "file").withColumn("slide_id", _slide())
    more, bad = parse_features(named(elements).select("path", "slide_id", F.col("pos").cast("int").alias("pos"), F.col("element").alias("feature")))
    refused = named(broken).select("path", "slide_id", F.lit(None).cast("int").alias("pos"), "reason")
    return annotations.unionByName(more), rejects.unionByName(bad).unionByName(refused)


def _slide() -> Column:
    folder = F.regexp_extract("path", r"slide_id=([^/]+)/", 1)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return F.when(F.col("path").contains("/slide_id="), folder).otherwise(stem)


def features(annotations: DataFrame) -> DataFrame:
    """Each annotation as the text of a GeoJSON feature."""
    pairs = F.transform("coordinates", lambda p: F.array(p["x"], p["y"]))
    closed = F.when(
        (F.size("pairs") > 0) & (F.get("pairs", 0) != F.element_at("pairs", -1)),
        F.concat("pairs", F.slice("pairs", 1, 1)),
    ).otherwise(F.col("pairs"))
    x = lambda i: F.get(F.get("pairs", i), 0)
    y = lambda i: F.get(F.get("pairs", i), 1)
    corners = F.when(
        F.size("pairs") >= 2,
        F.array(
            F.array(x(0), y(0)), F.array(x(1), y(0)), F.array(x(1), y(1)), F.array(x(0), y(1)), F.array(x(0), y(0))
        ),
    ).otherwise(F.array().cast(f"array<{_PAIR}>"))
    point = F.coalesce(F.get("pairs", 0), F.array(F.lit(0.0), F.lit(0.0)))
    as_text = lambda value: F.to_json(value)
    coordinates = (
        F.when(F.col("type") == "point", as_text(point))
        .when(F.col("type") == "rectangle", as_text(F.array(corners)))
        .otherwise(as_text(F.array(closed)))
    )
    geometry_type = F.when(F.col("type") == "point", "Point").otherwise("Polygon")
    properties = F.to_json(
        F.map_concat(
            F.create_map(F.lit("annotation_type"), F.col("type")),
            F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: k != "annotation_type"),
        )
    )
    quoted = lambda value: F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    text = F.concat(
        F.lit('{"type":"Feature","id":'), quoted(F.col("annotation_id")),
        F.lit(',"geometry":{"type":"'), geometry_type, F.lit('","coordinates":'), coordinates,
        F.lit('},"properties":'), properties, F.lit("}"),
    )
    return annotations.withColumn("pairs", pairs).withColumn("feature", text).drop("pairs")


def annotation_documents(
    annotations: DataFrame, order: str = "pos", max_features: int = 50_000, max_bytes: int = 64 << 20
) -> DataFrame:
    """FeatureCollection text per slide, features in their order.

    A slide with more than ``max_features`` annotations or about ``max_bytes``
    of text gets several documents (``part``), cut in order, so that no task has
    to hold all of a huge slide.  Each part carries the position of its first
    feature, from which the reader restores the order of the whole slide.
    """
    texts = features(annotations).select("slide_id", order, "annotation_id", "feature")
    numbered = number_rows(texts, ["slide_id"], [order, "annotation_id"], "_n")
    count = F.count(F.lit(1))
    sizes = numbered.groupBy("slide_id").agg(
        F.ceil(count / F.greatest(F.ceil(count / F.lit(max_features)), F.ceil(F.sum(F.length("feature")) / F.lit(max_bytes)))).alias("_each")
    )
    parted = salted_join(numbered, sizes, ["slide_id"])
    return (
        parted.withColumn("part", F.floor((F.col("_n") - 1) / F.col("_each")).cast("int"))
        .groupBy("slide_id", "part")
        .agg(F.min("_n").alias("_first"), F.sort_array(F.collect_list(F.struct("_n", "feature"))).alias("_f"))
        .select(
            "slide_id", "part",
            F.concat(
                F.lit('{"type":"FeatureCollection","first_position":'), F.col("_first") - 1, F.lit(',"features":['),
                F.array_join(F.col("_f.feature"), ","),
                F.lit("]}"),
            ).alias("document"),
        )
    )


def write_annotations(annotations: DataFrame, path: str, order: str = "pos", max_features: int = 50_000) -> None:
    """Write the documents under ``path/slide_id=.../part=.../``."""
    documents = annotation_documents(annotations, order, max_features)
    # One task per part opens its folder, and no task opens all of them.
    documents.repartition("slide_id", "part").write.partitionBy("slide_id", "part").mode(
        "overwrite"
    ).text(path)
