"""Operations of a training-data pipeline: one module per operator.

Nothing outside this subpackage imports it; queries are in ``queries.py``.
"""
