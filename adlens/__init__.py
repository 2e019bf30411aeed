"""adlens: ad-performance analytics on Spark DataFrames.

read -> normalize -> row metrics -> flag (isolation forest / z-sum) -> explain
-> totals, rollups, series -> report tables; batch or as files arrive.
"""

__version__ = "0.1.0"
