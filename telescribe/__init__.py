"""A PySpark engine for robot telemetry and log diagnostics."""
