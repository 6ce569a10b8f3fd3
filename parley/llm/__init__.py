"""Training-data operators.

Ten operators for building text corpora, one module each, plus
``queries``/``oracles`` (registered by ``__spark_entry__.py`` when this
subpackage is present).  Nothing outside ``parley.llm`` imports it.
"""
