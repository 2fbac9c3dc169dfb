"""Project documents and their references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake import schema as S

# Fixed defaults of a restored view.
VIEW_DEFAULTS = {"x": 0.0, "y": 0.0, "scale": 0.1}


def parse_projects(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, document)`` to ``(projects, rejects)``, absent keys filled with defaults."""
    keys = F.json_object_keys("document")
    read = documents.withColumn("doc", F.from_json("document", S.PROJECT)).withColumn("keys", keys)
    good = read.filter(F.col("keys").isNotNull())
    text = lambda name, default="": F.coalesce(F.col(f"doc.{name}"), F.lit(default)).alias(name)
    no_metadata = F.create_map().cast("map<string,string>")
    projects = good.select(
        "path",
        text("version", "1.0"), text("slide_path"), text("annotations_file"),
        F.struct(
            *[F.coalesce(F.col(f"doc.view_state.{k}"), F.lit(v)).alias(k) for k, v in VIEW_DEFAULTS.items()]
        ).alias("view_state"),
        text("created_at"), text("modified_at"),
        F.coalesce("doc.metadata", no_metadata).alias("metadata"),
        F.coalesce("doc.version", F.lit("1.0")).isin(S.PROJECT_VERSIONS).alias("known_version"),
    )
    rejects = read.filter(F.col("keys").isNull()).select("path", F.lit("malformed JSON").alias("reason"))
    return projects, rejects


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read project documents from files."""
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")
    )
    return parse_projects(texts)


def project_documents(projects: DataFrame) -> DataFrame:
    """JSON text of each project."""
    fields = [f.name for f in S.PROJECT.fields]
    others = [c for c in projects.columns if c not in (*fields, "known_version")]
    return projects.select(*others, F.to_json(F.struct(*fields)).alias("document"))


def write_projects(projects: DataFrame, path: str, key: str = "project_id") -> None:
    """Write one document per project under ``path/<key>=.../``."""
    project_documents(projects).select(key, "document").write.partitionBy(key).mode("overwrite").text(path)


def check_projects(projects: DataFrame, slides: DataFrame, annotation_files: DataFrame) -> DataFrame:
    """Broken references: no slide path, unknown slide, missing annotation file.

    ``slides(slide_path)`` and ``annotation_files(path)`` list what exists.
    """
    known = slides.select("slide_path").distinct().withColumn("_slide", F.lit(True))
    files = annotation_files.select(F.col("path").alias("annotations_file")).distinct().withColumn("_file", F.lit(True))
    reason = (
        F.when(F.trim("slide_path") == "", "missing slide path")
        .when(F.col("_slide").isNull(), "slide not found")
        .when((F.col("annotations_file") != "") & F.col("_file").isNull(), "annotation file not found")
    )
    return (
        projects.join(known, "slide_path", "left")
        .join(files, "annotations_file", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .drop("_slide", "_file")
    )
