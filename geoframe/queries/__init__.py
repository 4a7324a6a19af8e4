"""The registered geometry queries and their SQL."""

from geoframe.queries import catalog_files, catalog_more  # noqa: F401  (register their queries)
from geoframe.queries.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
