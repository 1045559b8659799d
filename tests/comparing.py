"""Comparison of a query with its SQL."""


def same_rows(frame, relation):
    """Rows of a Spark result and of a DuckDB relation, in no order, columns by name."""
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    ours = sorted((tuple(r[c] for c in names) for r in frame.collect()), key=repr)
    at = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(r[k] for k in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
