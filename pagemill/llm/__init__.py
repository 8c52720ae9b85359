"""Training-data operators: URL filtering, deduplication, decontamination,
language identification, toxicity, privacy and source mixing.

Each module holds one operator with a general interface over DataFrames;
``queries`` applies them to the standard tables. Nothing outside this package
(but the entry point and ``corpus_pipeline``) imports it.
"""
