"""Training-data operators: filtering, deduplication, tokenizing, scoring, packing.

Nothing outside this folder (and `corpus_pipeline.py`) imports it.  Each module
holds one operator with its own general interface; `queries.py` holds the thin
queries over the shared tables.
"""
