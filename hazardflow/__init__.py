"""Sensor-table quality, cleaning, risk scoring and monitoring on Spark."""
