"""Relational operators: DataFrame in, DataFrame out, with ``sample`` in every key."""
