"""A Spark-native engine that audits tabular data: rules, integrity checks, findings, reports."""
