"""Every registered query: what to run on Spark and, where SQL can express it, the same in SQL."""

from registry.core import QUERIES
from registry import scalars, watermarks, results, house, taxi, streams  # noqa: F401  (each registers its queries)
