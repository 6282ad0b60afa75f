"""Training-data pipeline operators.

Each module holds one operator with a general interface; ``queries`` binds them
to the tables.  Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
