"""A Spark-native engine for curating, scoring and analysing labelled data sets."""
