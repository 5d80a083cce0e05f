"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.  Each
operator module has a general interface returning its real outputs; the thin
``opN_<name>`` queries in ``queries.py`` derive the digest columns from them.
"""
