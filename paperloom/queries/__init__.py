"""All queries over the driver's tables: importing this registers them."""

from . import artefacts, catalog, files
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "artefacts", "catalog", "files"]
