"""Spark-native message-risk analytics: operators are DataFrame -> DataFrame functions."""
