"""All registered queries."""

from . import contour_queries, graph_queries, interval_queries, label_queries, length_queries, page_queries, place_queries, provider_queries, review_queries, route_queries, rule_queries, spatial_queries, store_queries, stream_queries, text_queries, word_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
