"""Operators for building training data from text at scale.

Every operator is a function over DataFrames; ``queries`` registers one
contract query per operator.  Nothing outside this subpackage (apart from the
guarded import in ``__spark_entry__.py`` and ``corpus_pipeline.py``) uses it.
"""
