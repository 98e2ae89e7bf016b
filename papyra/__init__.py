"""papyra: a PySpark-native document retrieval and text-processing engine."""
