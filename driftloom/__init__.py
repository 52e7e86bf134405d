"""driftloom: PySpark-native analytics over prompt, response, token and vector tables."""

__version__ = "0.1.0"
