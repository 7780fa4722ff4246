"""campuslens: campus-operations analytics as Spark DataFrame operators.

Modules: ``operators`` (filters, joins, aggregates, windows, changes,
quality), ``sources`` (I/O), ``functions`` (column expressions),
``plans`` (bindings to the driver tables, range-partitioned ordering,
registered queries) and ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
