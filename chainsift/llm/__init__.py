"""Training-data operators: one module for each, and ``catalog`` with their queries.

Nothing outside this subpackage (but ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) imports it.
"""
