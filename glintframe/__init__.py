"""A Spark-native engine for the data side of perception workloads."""
