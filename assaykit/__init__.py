"""Assessment analytics and text processing as composable Spark DataFrame operators."""
