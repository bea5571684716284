"""Registered plans."""
import importlib
import importlib.util

FAMILIES = ("text_queries", "anchor_queries", "geometry_queries", "check_queries", "diff_queries", "profile_queries",
            "log_queries", "eval_queries", "source_queries", "stream_queries")


def load_queries():
    from .registry import QUERIES
    for family in FAMILIES:
        name = f"{__name__}.{family}"
        if importlib.util.find_spec(name):
            importlib.import_module(name)
    return QUERIES
