"""What tests share to look at results."""


def rows(df, *columns):
    """Rows of the named columns as sorted tuples."""
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
