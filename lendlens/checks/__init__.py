"""Named queries over a star-schema folder, each with the SQL that must give the same rows."""

from .registry import CHECKS, Context, compared_sql, run_check
from . import acceptance, drivers, evaluation, layers, quality, scalars, sources  # noqa: F401  (register checks)

__all__ = ["CHECKS", "Context", "compared_sql", "run_check"]
