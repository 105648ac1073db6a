"""Column functions that the operators are made of, in one place."""

from pixelweave.operators.align import negative_inverse, pixel_sizes
from pixelweave.operators.filters import area_bound_px, finite, setting
from pixelweave.operators.focus import skip_of
from pixelweave.operators.measure import ratio
from pixelweave.operators.table import analysis_folder, identity_column, object_id, short_name, slug, stage_position, tile_name
from pixelweave.pixels import in_micrometres

__all__ = [
    "analysis_folder", "area_bound_px", "finite", "identity_column", "in_micrometres", "negative_inverse", "object_id", "pixel_sizes", "ratio", "setting", "short_name", "skip_of", "slug", "stage_position", "tile_name",
]
