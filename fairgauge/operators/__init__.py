"""DataFrame operators; each is ``f(df, ...) -> DataFrame`` with no collect."""
