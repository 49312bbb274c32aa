"""kinlens: a Spark-native engine for media libraries and text corpora.

``operators`` holds relational and clustering operators, ``sources`` readers and the snapshot store,
``functions`` column expressions, ``plans`` composed queries, ``streaming`` the incremental paths.
"""

__version__ = "0.1.0"
