"""lumenlex: a Spark-native engine for text corpora and full-softmax word embeddings."""
