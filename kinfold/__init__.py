"""kinfold: Spark-native analysis of families in large sets of annotated sequences."""
