"""Spark-native gap filling, inter-calibration and validation of gridded observations."""
