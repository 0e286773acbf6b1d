"""All registered queries, by theme."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, ROWS, oracle_texts

THEMES = (
    "bars",
    "features",
    "portfolio",
    "pnl",
    "quality",
    "inference",
    "folds",
    "curves",
    "vol",
    "regime",
    "spreads",
    "streams",
)
MODULES: dict[str, str] = {}
for _theme in THEMES:
    _seen = set(QUERIES)
    importlib.import_module(f"{__name__}.{_theme}")
    MODULES.update({k: _theme for k in QUERIES if k not in _seen})

__all__ = ["MODULES", "ORACLES", "QUERIES", "ROWS", "THEMES", "oracle_texts"]
