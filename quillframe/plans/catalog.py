"""All registered queries."""

from __future__ import annotations

from quillframe.plans import fields, library, roundtrips, selection, series, settings, signals, stateful, stored, tables, texts  # noqa: F401
from quillframe.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "reconcile_flagship"
