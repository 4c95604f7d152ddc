"""Training-data operators: filtering, deduplication, sanitising, tokenising, packing, archives.

Nothing outside this subpackage (and `corpus_pipeline.py`) imports it.
"""
