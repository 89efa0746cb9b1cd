"""Rows of different engines, made comparable."""


def plain(rows):
    """Rows as sorted tuples of values that compare across engines."""

    def one(v):
        if v is None or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, bool) or isinstance(v, float) and v == int(v) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)
