"""All queries by name; importing this registers them."""

from tallyforge.plans import business, core, files, learned, more, single, steps  # noqa: F401
from tallyforge.plans.registry import QUERIES, SQL  # noqa: F401
