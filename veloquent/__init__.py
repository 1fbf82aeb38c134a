"""Spark-native analytics for spoken-language scores and the usage data around them."""
