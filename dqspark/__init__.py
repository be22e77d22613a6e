"""Spark-native data reliability: profile, check, compare, trace and explain tables of any size."""
