"""Spark-native evaluation analytics: scan, standardise, score and roll up model responses at cluster scale."""
