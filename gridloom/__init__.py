"""gridloom: a PySpark-native engine for metered-consumption telemetry."""

__version__ = "0.1.0"
