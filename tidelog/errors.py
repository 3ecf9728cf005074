"""What can be wrong with a query; all are raised on the driver, before a plan exists."""


class QueryError(ValueError):
    """Base of the errors below."""


class UnsupportedQueryError(QueryError):
    """A form outside the grammar. ``path`` says where, ``form`` is what was found."""

    def __init__(self, path: str, form: object, why: str = "") -> None:
        super().__init__(f"unsupported query at {path}: {form!r}" + (f" ({why})" if why else ""))
        self.path, self.form = path, form


class UnboundVariableError(QueryError):
    """A variable of :find or of a predicate that no pattern binds."""


class UnknownAttributeError(QueryError):
    """An attribute that the catalog lacks."""


class TypeMismatchError(QueryError):
    """A comparison of values that have no common order."""
