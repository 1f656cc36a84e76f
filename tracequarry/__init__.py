"""tracequarry: a PySpark-native analytics engine for agent-trajectory data."""

__version__ = "0.1.0"
