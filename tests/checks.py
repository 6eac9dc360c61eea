"""Comparison of a query with its SQL."""


def same(df, con, sql):
    """Rows, whatever their order, and column names of a query and its SQL."""

    def rows(frame, columns):
        plain = frame[columns].astype(object).where(frame[columns].notna(), None)
        return sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in plain.itertuples(index=False, name=None))

    got, want = df.toPandas(), con.execute(sql).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
