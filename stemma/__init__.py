"""Spark-native checklist and knowledge-graph analytics."""
