"""Training-data operators: one module per operator, queries in ``registry``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
