"""Every registered query of the library with the SQL that states its result."""

from __future__ import annotations

from . import q_anomaly, q_catalog, q_functions, q_history, q_navigation, q_recorder, q_registration

_MODULES = [q_anomaly, q_catalog, q_functions, q_history, q_navigation, q_recorder, q_registration]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
