"""Analyses over relational tables: meshes, fields and probes derived from their rows."""

from quadfield.plans import boundary_plans, field_plans, force_plans, probe_plans, series_plans, view_plans  # noqa: F401
from quadfield.plans.registry import ORACLES, QUERIES  # noqa: F401
