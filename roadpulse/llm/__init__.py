"""Training-data operators and their queries.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it can be imported. ``corpus_pipeline.py`` at the
repository top chains five of the operators.
"""
