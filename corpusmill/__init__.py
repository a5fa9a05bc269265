"""corpusmill: a Spark-native engine for preparing and analysing text corpora."""
