"""Operators over case records, by theme. Importing this package declares their views."""

from ..plans import projection  # noqa: F401
from . import actions, closure, dashboard, desks, discards, duplicates, evaluation, experiments, handoff, journey, loads, metrics, privacy, routing, spike, textdedup, triage  # noqa: F401
