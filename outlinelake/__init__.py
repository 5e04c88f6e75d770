"""Spark-native engine for collections of outline files."""
