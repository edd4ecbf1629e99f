"""Training-data operators: extraction, language id, quality, dedup, mixing and packing.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; :mod:`tracewright.llm.queries` registers the thin ``opN_`` queries.
"""
