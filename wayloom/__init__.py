"""wayloom: a PySpark-native engine for geo-semantic catalogs."""
