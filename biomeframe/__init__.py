"""A Spark-native engine for quantitative metagenomic profiling."""
