"""Spark-native forensics over transaction ledgers and the relay telemetry seen with them."""
