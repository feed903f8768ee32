"""Queries over the given tables, grouped by family; importing this package fills the registry."""

import importlib

MODULES = (
    "rules", "scalars", "joins", "rates", "ticks", "ordered", "sampling", "sets",
    "decisions", "colors", "similarity", "semantic", "storage",
)

for _m in MODULES:
    importlib.import_module(f"{__name__}.{_m}")

from gaugeframe.plans.catalog import ORACLES, QUERIES  # noqa: E402,F401
