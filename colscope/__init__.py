"""colscope: schema catalog and column profiling for data lakes, as Spark jobs.

The public surface is ordinary functions that take and return DataFrames:

* ``colscope.sources``    discover files, scan CSV/Parquet, keep the catalog, export results
* ``colscope.operators``  profile columns; list, search, relate and check catalog rows
* ``colscope.plans``      the eight catalog tools and the registered queries
"""

__version__ = "0.1.0"
