"""Every query of the library outside the training-data operators, with its SQL."""

from __future__ import annotations

from .plans import documents, layouts, structures, trees

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (documents, layouts, structures, trees):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
