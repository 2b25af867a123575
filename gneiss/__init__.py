"""gneiss: a Spark-native analytics engine for source, retrieval and evaluation relations."""
