"""Operators for training data and entity resolution that rest on learned or probabilistic methods.

Nothing outside this package imports it; ``partweave.llm.queries`` lists its queries.
"""
