"""tamarack: a Spark-native analytics engine for job-market data and text corpora."""
