"""siftwork: a Spark-native engine for hybrid retrieval over files and documents."""
