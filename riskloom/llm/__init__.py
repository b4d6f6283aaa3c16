"""Training-data operators: language ID, deduplication, quality, tokens, PII.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
