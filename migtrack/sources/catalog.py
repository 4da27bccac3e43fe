"""Catalogue sources over JDBC (routine and parameter catalogues).

The filter and projection are sent inside the JDBC query, so the source
database does them. For a large catalogue pass Spark's ``partitionColumn``,
``lowerBound``, ``upperBound`` and ``numPartitions`` options (for parameters,
``ordinal_position`` works): the query is then sent as a sub-select and read
as that many parallel range queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: the standard INFORMATION_SCHEMA views and columns the catalogue is read from
ROUTINES_QUERY = """
SELECT SPECIFIC_CATALOG AS dbname, SPECIFIC_SCHEMA AS schema_name, SPECIFIC_NAME AS procedure_name,
       ROUTINE_DEFINITION AS procedure_definition
FROM INFORMATION_SCHEMA.ROUTINES WHERE ROUTINE_TYPE = 'PROCEDURE'"""

PARAMS_QUERY = """
SELECT SPECIFIC_NAME AS procedure_name, PARAMETER_MODE AS mode, PARAMETER_NAME AS name,
       DATA_TYPE AS data_type, CHARACTER_MAXIMUM_LENGTH AS char_length, ORDINAL_POSITION AS ordinal_position
FROM INFORMATION_SCHEMA.PARAMETERS"""


def jdbc_reader_options(query: str, options: dict) -> dict:
    """Reader options: ``query`` for one read, a ``dbtable`` sub-select for a partitioned read."""
    out = dict(options)
    if "partitionColumn" in out:
        out["dbtable"] = f"({query.strip()}) catalogue_rows"
    else:
        out["query"] = query
    return out


def _jdbc(spark: SparkSession, query: str, options: dict) -> DataFrame:
    reader = spark.read.format("jdbc")
    for k, v in jdbc_reader_options(query, options).items():
        reader = reader.option(k, v)
    return reader.load()


def read_routines(spark: SparkSession, options: dict) -> DataFrame:
    """A1: procedures of the source catalogue (``options``: url, user, password, driver...)."""
    return _jdbc(spark, ROUTINES_QUERY, options)


def read_params(spark: SparkSession, options: dict) -> DataFrame:
    """A2: parameter rows; the ordinal stays a column (ordering happens in the aggregate)."""
    return _jdbc(spark, PARAMS_QUERY, options)
