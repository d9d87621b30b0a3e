from . import archive, classes, curation, evidence, finding, portal, relational, rulebooks, scripts, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
