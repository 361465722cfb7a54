"""gridsense: Spark-native understanding of many small, messy, untyped tables."""
