"""Training-data operators: dedup, decontamination, quality, PII, secrets, licences, sharding, chat, tokens.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
