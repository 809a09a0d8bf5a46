"""Importing this module registers every query of the library."""

from datumloom.operators import assess, audit, capture, cardinality, compare, comply, constraints, datasets, detect, discover, generate, infer, injection, mask_tables, pack, perturb, planning, privacy, profile, relational, scenarios, sketches, split, steps, timed_joins
from datumloom.registry import ORACLES, QUERIES
from datumloom.sources import dumps, tables
from datumloom.streaming import machines, simulate, windows

__all__ = [
    "ORACLES", "QUERIES", "assess", "audit", "capture", "cardinality", "compare", "comply", "constraints", "datasets", "detect", "discover", "dumps", "generate", "infer", "injection", "machines", "mask_tables", "pack", "perturb", "planning", "privacy", "profile",
    "relational", "scenarios", "simulate", "sketches", "split", "steps", "tables", "timed_joins", "windows",
]
