"""tidewell: a PySpark-native analytics engine for timestamped community text."""
