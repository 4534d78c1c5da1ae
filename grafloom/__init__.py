"""Spark-native analytics over knowledge-graph extraction data.

Subpackages: ``functions`` (column builders), ``operators`` (DataFrame to
DataFrame), ``sources`` (tables, gold records, extraction), ``streaming``
(incremental graph merge), ``plans`` (named queries with their SQL twins) and
``llm`` (training-data operators; optional, nothing else imports it).
"""
