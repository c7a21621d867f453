"""Jobs and queries.  Importing the query modules fills the registry."""

from gleanery.plans import assembly, cleaning, crawls, extraction, files, maintenance, matching  # noqa: F401
from gleanery.plans.registry import ORACLES, QUERIES  # noqa: F401
