"""Sources (JDBC catalogues, files, logs) and sinks (tables, snapshots, exports)."""
