"""Spark-native text moderation, redaction and rate guards over DataFrames."""
