"""Orrery: a PySpark-native engine for governed semantic analytics."""
