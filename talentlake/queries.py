"""The registered queries of the library, by name, with DuckDB SQL for each that SQL can express."""

from talentlake.plans import detail_queries, job_queries, life_queries, match_queries, other_queries  # noqa: F401  (importing registers)
from talentlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
