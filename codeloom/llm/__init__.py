"""Operations of a training-data pipeline: deduplication, filtering, cleaning and tokenisation of documents.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
