"""Training-data operators: dedup, decontamination, packing, formatting, scoring and archives.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
