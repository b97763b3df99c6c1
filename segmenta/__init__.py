"""segmenta: a Spark-native document segmentation and span-embedding engine."""
