"""penlight: Spark-native analytics for pen-level livestock monitoring."""
