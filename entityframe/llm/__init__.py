"""Training-data pipeline operators (ten first-class components).

Nothing outside this subpackage imports it, apart from the guarded hook in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
