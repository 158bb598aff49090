"""All queries of the engine; importing this fills the registry."""

from rasterloom.plans import documents, drawing, editing, effects, functions, gestures, layers, library, matrix, pixels, resampling, tilesets  # noqa: F401
from rasterloom.registry import ORACLES, QUERIES  # noqa: F401
