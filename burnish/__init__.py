"""burnish: cleaning tabular data and measuring its quality, on Spark DataFrames."""

from burnish.errors import CleaningError

__all__ = ["CleaningError"]
