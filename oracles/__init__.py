"""DuckDB SQL for the registered queries: what the tests and the correctness gate compare with.

Not part of the library. Word lists are taken from the library's fixed values;
the SQL is written with DuckDB's own functions.
"""

from . import ops, pages, text, v1  # noqa: F401  (register on import)
from .base import ORACLE  # noqa: F401
