"""Panels: reading, validation, derivation and synthesis; metadata tables."""

from .metadata import borrow_rates, fill_borrow_rates, hard_to_borrow, sector_map
from .panel import FIELDS, get_panel, read_json, read_jsonl, read_panel, supplier_panel, synthetic_panel, user_panel, validate_panel

__all__ = ["FIELDS", "borrow_rates", "fill_borrow_rates", "get_panel", "hard_to_borrow", "read_json", "read_jsonl", "read_panel", "sector_map", "supplier_panel", "synthetic_panel", "user_panel", "validate_panel"]
