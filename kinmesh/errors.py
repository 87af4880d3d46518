"""Hard errors of data and runtime.  Misuse of an interface raises ValueError or KeyError instead; a pair that a
matcher cannot decide is no exception but a row of the error channel."""


class LinkageError(Exception):
    """Any error of this family."""


class UnknownIdColumn(LinkageError):
    pass


class EmptySource(LinkageError):
    pass


class DuplicateRecordId(LinkageError):
    pass


class DimensionMismatch(LinkageError):
    pass


class InvalidTopK(LinkageError):
    pass


class IncompatibleStore(LinkageError):
    pass
