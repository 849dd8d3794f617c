"""Bindings of the operators to the analytic tables, one module per domain."""

import importlib

MODULES = ["fields", "vortices", "tracks", "filters", "series", "similarity", "contours", "modal", "learn", "sources", "streams"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"wakeframe.plans.{name}")
