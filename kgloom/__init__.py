"""kgloom: a PySpark-native engine for building, scoring and curating knowledge graphs."""

__version__ = "0.1.0"
