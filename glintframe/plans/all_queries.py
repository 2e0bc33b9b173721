"""Every registered query of the library."""

from glintframe.plans import box_queries, catalog_queries, grid_queries, image_queries, layout_queries, speech_queries, text_queries, vector_queries  # noqa: F401
from glintframe.plans.registry import QUERIES, SQL  # noqa: F401
