"""Named queries over a folder of Parquet tables, with their SQL twins."""

from seqweft.plans import file_queries  # noqa: F401  it adds its queries to the others
from seqweft.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
