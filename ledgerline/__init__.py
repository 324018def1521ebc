"""A strict, typed SQL engine whose plans are Spark DataFrames."""

from .database import Database
from .errors import EngineError
from .limits import Limits

__all__ = ["Database", "EngineError", "Limits"]
