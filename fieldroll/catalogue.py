"""All registered queries of the library, and their SQL."""

from .queries import details, folders, imports, listings, names, people, progress, records, reports, rows, stores, tables, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
