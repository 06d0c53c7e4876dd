"""Named queries, each with the SQL of the same rows."""

from seamark.plans import cascades, extras, graphs, inference, network, outputs, places, scores, search, texts, tracks
from seamark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cascades", "extras", "graphs", "inference", "network", "outputs", "places", "scores", "search", "texts", "tracks"]
