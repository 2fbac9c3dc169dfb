"""Table shapes and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: they decide results and file formats -------------------
TILE_SIZE = 512
TARGET_MPP = 0.5
FALLBACK_MPP = 0.25
MAGNIFICATION_AT_1_MPP = 10.0
BACKGROUND = (255, 255, 255)
THUMBNAIL_MAX_SIZE = 1024
CACHE_MISS_THRESHOLD = 0.3
MAX_RECENT = 10
SLIDE_EXTENSIONS = [".svs", ".ndpi", ".tif", ".tiff", ".mrxs", ".vms", ".vmu", ".scn"]
MPP_PROPERTIES = ["openslide.mpp-x", "aperio.MPP"]
TILE_FORMAT = "pack_v2"
METADATA_REQUIRED = ["version", "source_file", "tile_size", "dimensions", "levels"]
METADATA_KEYS = [
    "version", "source_file", "source_mpp", "target_mpp", "target_magnification",
    "tile_size", "dimensions", "levels", "background_color", "preprocessed_at",
]
INDEX_MAGIC = b"FPLIDX1\0"
INDEX_VERSION = 1
INDEX_HEADER_BYTES = 16
INDEX_ENTRY_BYTES = 12
MAX_GRID_SIDE = 65535
MAX_TILE_BYTES = 2**32 - 1
PROJECT_VERSIONS = ["1.0"]
DEFAULT_LABEL = ""
DEFAULT_COLOR = "#ff6b6b"
DEFAULT_COLOR_RGB = (255, 107, 107)
DEFAULT_NOTES = ""
DEFAULT_GROUP = "default"
UNKNOWN_LABEL = "Unknown"
UNKNOWN_COLOR = "#808080"
CELL_TYPES = {
    1: ("Neoplastic", "#ff0000"),
    2: ("Inflammatory", "#22dd4d"),
    3: ("Connective", "#235cec"),
    4: ("Dead", "#feff00"),
    5: ("Epithelial", "#ff9f44"),
}
PATCH_SIZE = 1024
PATCH_OVERLAP = 64
MAX_VISIBLE_TILES = 256
EXTENDED_TILE_BUDGET = 32
WARMUP_MAX_TILES = 64
# --------------------------------------------------------------------------

# Suffixes of pyramid folders.  They are a naming choice of the deployment, so
# every operator that uses them takes them as parameters.
PYRAMID_SUFFIX = ".pyramid"
NATIVE_SUFFIX = ".pyramid_native"

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POINTS = T.ArrayType(POINT)

LEVEL = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("downsample", T.IntegerType()),
        T.StructField("cols", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_mpp", T.DoubleType()),
        T.StructField("target_mpp", T.DoubleType()),
        T.StructField("target_magnification", T.DoubleType()),
        T.StructField("tile_size", T.IntegerType()),
        T.StructField("dimensions", T.ArrayType(T.IntegerType())),
        T.StructField("levels", T.ArrayType(LEVEL)),
        T.StructField("background_color", T.ArrayType(T.IntegerType())),
        T.StructField("preprocessed_at", T.StringType()),
        T.StructField("tile_format", T.StringType()),
        T.StructField("native_mpp_mode", T.BooleanType()),
    ]
)

VIEW_STATE = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
    ]
)

PROJECT = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("slide_path", T.StringType()),
        T.StructField("annotations_file", T.StringType()),
        T.StructField("view_state", VIEW_STATE),
        T.StructField("created_at", T.StringType()),
        T.StructField("modified_at", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
