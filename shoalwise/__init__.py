"""Community time-series analytics for Spark.

Long tables of sampled counts go in; richness, diversity, occurrence,
accumulation, trait, trend and model tables come out.  Every operator is a
plain function over DataFrames that takes column names as parameters.
"""

from shoalwise import functions, operators, sources

__all__ = ["functions", "operators", "sources"]
__version__ = "0.1.0"
