"""lethe: a Spark-native text de-identification engine.

The subpackages hold sources and sinks, entity functions, allocation / rewrite /
verification operators, query plans and streaming.  ``lethe.llm`` adds corpus
operators for training data; nothing else in the library imports it.
"""

__version__ = "0.1.0"
