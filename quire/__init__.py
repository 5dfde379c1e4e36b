"""quire: document analytics as composable Spark DataFrame transformations."""
