"""Customer-retention analytics as Spark jobs.

Layers: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (contracts, tables in and out), ``streaming`` (the same
expressions on streams) and ``plans`` (whole jobs and registered queries).
"""
