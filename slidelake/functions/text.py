"""Tile addresses, colours, file names and slide identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slidelake.schema import DEFAULT_COLOR_RGB

# Fixed format of a tile address: level/col_row?g=generation
TILE_URL = r"^([+-]?\d+)/([+-]?\d+)_([+-]?\d+)$"
HEX_COLOR = r"^#*([0-9a-fA-F]{6})$"


def parse_tile_url(url: Column) -> Column:
    """``level/col_row?g=n`` to a struct; null when malformed, generation 0 when absent."""
    address = F.substring_index(url, "?", 1)
    query = F.when(F.locate("?", url) > 0, url.substr(F.locate("?", url) + 1, F.length(url)))
    tagged = query.startswith("g=")
    generation = F.when(tagged, query.substr(F.lit(3), F.length(url)).try_cast("bigint")).otherwise(
        F.lit(0).cast("bigint")
    )
    generation = F.when(query.isNull(), F.lit(0).cast("bigint")).otherwise(generation)
    level, col, row = (F.regexp_extract(address, TILE_URL, i).try_cast("int") for i in (1, 2, 3))
    valid = level.isNotNull() & col.isNotNull() & row.isNotNull() & generation.isNotNull()
    return F.when(
        valid,
        F.struct(
            level.alias("level"), col.alias("col"), row.alias("row"), generation.alias("generation")
        ),
    )


def format_tile_url(level: Column, col: Column, row: Column, generation: Column) -> Column:
    """Inverse of :func:`parse_tile_url`."""
    return F.format_string("%d/%d_%d?g=%d", level, col, row, generation)


def parse_hex_color(color: Column) -> Column:
    """``#rrggbb`` to a struct of three ints; anything else gives the default colour."""
    digits = F.regexp_extract(color, HEX_COLOR, 1)
    known = F.length(F.coalesce(digits, F.lit(""))) == 6

    def channel(index: int) -> Column:
        value = F.conv(F.substring(digits, 2 * index + 1, 2), 16, 10).cast("int")
        return F.when(known, value).otherwise(F.lit(DEFAULT_COLOR_RGB[index]))

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def slide_id(path: Column) -> Column:
    """Stable 64-bit identifier of a slide path, ignoring letter case."""
    return F.xxhash64(F.lower(path))
