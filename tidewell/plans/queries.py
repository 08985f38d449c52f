"""Every registered query of the engine."""

import importlib

from tidewell.plans.registry import ORACLES, QUERIES

for _name in ("q_browse", "q_search", "q_forks", "q_index", "q_mid", "q_cards", "q_ingest", "q_labels", "q_history", "q_store"):
    importlib.import_module(f"tidewell.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
