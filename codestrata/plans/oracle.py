"""DuckDB SQL for the core queries that SQL can express on whole tables."""

from codestrata.plans.queries import MODULES

ORACLE: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE.items()}
