"""positdb: a Spark-native engine for conflicting, uncertain and time-varying information."""
