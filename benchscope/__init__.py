"""benchscope: Spark-native analytics over algorithm-benchmark result trees.

The library turns trees of small run files into two denormalised tables
(method level and metric level) and answers the usual benchmark questions on
them as plain ``DataFrame -> DataFrame`` functions built from Spark SQL
primitives.  See README.md for the operator map.
"""

__version__ = "0.1.0"
