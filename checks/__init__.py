"""Query registry used by the driver contract, the tests and the bench."""

from __future__ import annotations

import importlib

MODULES = ["q_scores30", "q_screens", "q_scores23", "q_series", "q_portfolio", "q_text", "q_history", "q_stream"]


def all_queries():
    from checks.registry import ORACLES, QUERIES

    for m in MODULES:
        importlib.import_module(f"checks.{m}")
    return dict(QUERIES), dict(ORACLES)
