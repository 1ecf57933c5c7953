"""Training-data operators: joins, search, tokens, quality, dedup, mixing, scoring, secrets, sharding.

One module per operator; ``queries`` registers one query ``opN_<name>`` each.
Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
