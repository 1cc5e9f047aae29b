"""Training-data operators: filters, dedup, decontamination, archives, scoring, mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
