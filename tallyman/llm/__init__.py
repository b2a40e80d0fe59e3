"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it: its queries are registered through
``tallyman.llm.queries`` and the pipeline at the top of the repository.
"""
