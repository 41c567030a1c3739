"""Training-data operators over a `documents` table (doc_id, text, lang, source, n_chars).

Nothing outside this subpackage imports it; `queries.py` lists its queries.
"""
