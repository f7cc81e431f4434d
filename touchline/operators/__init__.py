"""Relational operators, each ``f(df, parameters) -> df`` and lazy unless its docstring says otherwise."""
