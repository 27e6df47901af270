"""Spark-native analytics for labelled datasets and the experiments run on them."""
