"""Exceptions raised while a plan is being built or run."""


class SpecError(ValueError):
    """A spec, option or expression that cannot be turned into a plan."""


class TransformError(RuntimeError):
    """A custom transform failed on a record or a batch."""


class MissingConnectorError(RuntimeError):
    """The Spark connector a source or sink needs is not on the class path."""


class TableNotFoundError(LookupError):
    """A table name that is not in the catalogue."""
