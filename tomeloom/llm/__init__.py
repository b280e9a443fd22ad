"""Operators for preparing training corpora: ten methods over documents, pages and vectors.

Nothing outside this subpackage imports it. Queries over the standard tables live in
``tomeloom.llm.queries``, their SQL in ``tomeloom.llm.oracles``.
"""
