"""factloom: a PySpark-native analytics engine for program facts.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column functions),
``operators`` (relational operators), ``plans`` (fixpoints and whole analyses),
``streaming`` (Structured Streaming forms).
"""
