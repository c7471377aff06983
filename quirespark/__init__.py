"""Spark-first operators for long-form text, spoken-script tables and the events around them."""
