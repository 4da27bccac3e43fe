"""DataFrame operators: catalogue, keyed writes, test results, reports."""
