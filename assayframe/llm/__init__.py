"""Training-data operators.

One module an operator; ``queries.py`` holds the thin query of each.  Nothing
outside this folder (and ``corpus_pipeline.py``) imports it.
"""
