"""Fixed table layouts (tracking table, test-result log) as Spark schemas."""

from pyspark.sql import types as T

TRACKING_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("dbname", T.StringType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("procedure_name", T.StringType()),
    T.StructField("procedure_definition", T.StringType()),
    T.StructField("conversion_flag", T.BooleanType()),
    T.StructField("load_timestamp", T.TimestampNTZType()),
    T.StructField("target_dbname", T.StringType()),
    T.StructField("target_schema_name", T.StringType()),
    T.StructField("parameters", T.StringType()),
    T.StructField("is_deployed", T.BooleanType()),
    T.StructField("errors", T.StringType()),
])
TRACKING_COLUMNS = [f.name for f in TRACKING_SCHEMA.fields]

# event_id is the arrival order of an outcome; it travels with the row so that
# replays and out-of-order batches resolve to the same final state.
TEST_LOG_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("test_case_id", T.StringType()),
    T.StructField("test_case_name", T.StringType()),
    T.StructField("procedure_name", T.StringType()),
    T.StructField("test_timestamp", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("errors", T.StringType()),
])
TEST_LOG_COLUMNS = [f.name for f in TEST_LOG_SCHEMA.fields]

STAGE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("dbname", T.StringType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("procedure_name", T.StringType()),
    T.StructField("procedure_definition", T.StringType()),
    T.StructField("parameters", T.StringType()),
])
