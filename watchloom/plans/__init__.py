"""Query plans over the driver tables, grouped by theme."""

from importlib import import_module

from watchloom.plans.registry import ORACLES, QUERIES

THEMES = (
    "captures",
    "filters",
    "text",
    "calendars",
    "aggregates",
    "joins",
    "graphs",
    "sync",
    "rules",
    "lifecycle",
    "tables",
    "streams",
)


def load_all():
    for theme in THEMES:
        import_module(f"watchloom.plans.{theme}")
    return QUERIES, ORACLES
