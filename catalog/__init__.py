"""All registered queries, each over tables derived from the given ones."""


def load():
    from catalog import registry, scalars, tables, cells, scores, models  # noqa: F401
    return registry
