"""Column functions; all of them are built-in Spark expressions."""

from statelake.functions.hexes import (
    hex_rank, norm_hex, numeric_max_hex, render_binary, short_hex, to_hex,
)
from statelake.functions.integers import canonical_int, is_surrogate
from statelake.functions.paths import absolute_path, extension, file_name, name_index, stem
from statelake.functions.times import date_text, day_number, iso_seconds

__all__ = [
    "absolute_path", "canonical_int", "date_text", "day_number", "extension", "file_name", "hex_rank",
    "is_surrogate", "iso_seconds", "name_index", "norm_hex", "numeric_max_hex", "render_binary",
    "short_hex", "stem", "to_hex",
]
