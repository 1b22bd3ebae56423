from . import (  # noqa: F401
    catalog_queries,
    passage_queries,
    review_queries,
    round_queries,
    selection_queries,
    source_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
