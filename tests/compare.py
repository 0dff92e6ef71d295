"""Rows of a DataFrame and of an SQL result, by name, in any order."""


def same_rows(df, con, sql):
    table = df.toArrow()
    names = sorted(table.column_names)
    rel = con.sql(sql)
    columns = list(rel.columns)
    assert names == sorted(columns)
    ours = sorted(tuple(map(repr, row)) for row in zip(*(table.column(c).to_pylist() for c in names), strict=True))
    theirs = sorted(tuple(repr(row[columns.index(c)]) for c in names) for row in rel.fetchall())
    assert ours == theirs
