"""symloom: a Spark-native engine for typed symbol graphs.

Symbol tables go in, RDF triples come out as DataFrames, and graph patterns over those
triples compile to joins.  Nothing here imports ``symloom.llm``.
"""

__version__ = "0.1.0"
