"""Telemetry windows, forward failure labels and failure prediction on Spark."""
