"""Spark-native tracking and cleaning of SQL-script migrations.

Packages: ``functions`` (Column functions for script text, names, reports),
``sources`` (JDBC catalogues, script folders, uploads, logs, sinks),
``operators`` (catalogue, upsert, results, reports), ``plans`` (registered
queries and end-to-end flows), ``streaming`` (incremental result log).
"""

__version__ = "0.1.0"
