"""What is wrong with a definition or a query."""


class QueryError(ValueError):
    """A query that can't be parsed or doesn't fit its index."""


def need(condition: object, message: str) -> None:
    if not condition:
        raise QueryError(message)


def only(body: dict, allowed: str, where: str) -> dict:
    """body, if it is a document that has no field but the allowed ones (a ! marks those it must have)."""
    need(isinstance(body, dict), f"{where} must be a document")
    names = {a.strip("!"): a.endswith("!") for a in allowed.split()}
    unknown = sorted(set(body) - set(names))
    need(not unknown, f"{where}: unrecognized field {', '.join(unknown)}")
    missing = [n for n, must in names.items() if must and n not in body]
    need(not missing, f"{where}: {', '.join(missing)} is required")
    return body
