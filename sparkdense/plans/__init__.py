"""All named queries. Importing a plan module registers its queries."""

from sparkdense.plans import density, graphs, learning, relational, sequences, sources  # noqa: F401
from sparkdense.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
