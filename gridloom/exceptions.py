"""Errors of the library."""


class GridloomError(Exception):
    """Base of all errors of this library."""


class SourceResolutionError(GridloomError):
    """A source address names nothing, or several things."""


class UnsupportedBackendError(GridloomError):
    """A storage format or transport that isn't available here."""


class AmbiguousSelectionError(GridloomError):
    """A query matches several objects."""


class ObjectNotFoundError(GridloomError):
    """A query matches no object."""


class PartitionValidationError(GridloomError):
    """A partition plan that doesn't fit the selected data."""


class AdapterCompatibilityError(GridloomError):
    """A function that can't take the partitions or fill the output asked for."""


class OutputConflictError(GridloomError):
    """An output that exists and can't safely be used again."""


class IncompletePartitionError(GridloomError):
    """A partition without a valid manifest."""


class ProvenanceMismatchError(GridloomError):
    """Stored provenance of another workflow."""


class WorkflowSpecError(GridloomError, ValueError):
    """An invalid or unsupported workflow file."""
