"""Spark-native analytics over ordered tracks, run logs and text, written as DataFrame operators."""
