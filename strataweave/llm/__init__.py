"""Training-data operators: scanning, scoring, deduplication, packing and mixing of document corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which belongs to it) imports it.
"""
