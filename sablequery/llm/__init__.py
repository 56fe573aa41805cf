"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
