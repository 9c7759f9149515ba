"""All registered queries with the SQL they are checked against."""

from __future__ import annotations

import framesift.queries.images
import framesift.queries.records
import framesift.queries.review
import framesift.queries.text  # noqa: F401
from framesift.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
