"""Training-data operators: packing, tokenization, search, dedup, extraction and scoring.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
