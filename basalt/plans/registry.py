"""All registered queries of the core and their oracle SQL."""

from __future__ import annotations

from basalt.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
from basalt.plans import functions, multimodel, relational  # noqa: F401
