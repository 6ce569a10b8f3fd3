"""parley — Spark-native analytics for two-party conversations.

Turns, documents and live messages go in; cleaned token streams, growing
conversation prefixes, TF-IDF features, vocabulary-encoded sequences,
MLlib classifiers, evaluation tables and streaming verdicts come out.
Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and aggregates.
"""

from parley.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
