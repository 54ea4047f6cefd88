"""Performance-prediction analytics as Spark DataFrame jobs.

Layers: ``sources`` reads and writes, ``functions`` holds column expressions,
``operators`` holds DataFrame-to-DataFrame work, ``plans`` binds operators to
tables as named queries.
"""
