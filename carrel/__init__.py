"""carrel: a Spark-native engine for privacy-preserving work on record data."""
