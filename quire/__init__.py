"""quire: a PySpark-native engine for layout-aware document and text processing."""
