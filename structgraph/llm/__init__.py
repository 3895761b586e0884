"""Operators on the texts of code and documents for training data. Nothing outside this subpackage imports it."""


def queries() -> dict:
    from structgraph.llm import catalog

    return catalog.QUERIES


def sql() -> dict[str, str]:
    from structgraph.llm import catalog

    return catalog.SQL
