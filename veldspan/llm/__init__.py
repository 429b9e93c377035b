"""Operators for large training-data pipelines.

Nothing outside this folder imports it.  Each operator module has a general
interface of its own; ``queries`` derives the registered ``opN_*`` digests.
"""
