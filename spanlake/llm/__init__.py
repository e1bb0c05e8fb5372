"""Training-data operators: deduplication, search, classification, mixing, tokenising and archive audit.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query
per operator and the corpus pipeline.
"""
