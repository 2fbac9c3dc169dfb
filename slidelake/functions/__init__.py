"""Scalar column functions; all stay inside Spark's expression engine."""

from slidelake.functions.coords import (
    level_tile_side,
    slide_to_wsi_scale,
    tile_key,
    tile_key_parts,
    to_level,
    to_slide,
    to_wsi,
)
from slidelake.functions.text import (
    file_name,
    file_stem,
    format_tile_url,
    parse_hex_color,
    parse_tile_url,
    slide_id,
)

__all__ = [
    "file_name", "file_stem", "format_tile_url", "level_tile_side", "parse_hex_color",
    "parse_tile_url", "slide_id", "slide_to_wsi_scale", "tile_key", "tile_key_parts",
    "to_level", "to_slide", "to_wsi",
]
