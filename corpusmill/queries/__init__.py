"""Registered queries of the library, one module a family."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}

for _name in ("text", "retrieval", "relational", "ranking", "mining", "language", "activity", "understanding", "resolution", "names", "studies", "profiles", "interactive", "noise", "records"):
    _family = import_module(f"corpusmill.queries.{_name}").FAMILY
    QUERIES |= _family.queries
    ORACLES |= _family.oracles
