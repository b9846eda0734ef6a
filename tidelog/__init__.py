"""tidelog: Spark-native analytics over time-series archives of public discussion pages."""
