"""Named-axis array analytics on PySpark."""

__version__ = "0.1.0"

from gridloom.array import NamedArray  # noqa: E402
from gridloom.exceptions import (  # noqa: E402
    AdapterCompatibilityError,
    AmbiguousSelectionError,
    GridloomError,
    IncompletePartitionError,
    ObjectNotFoundError,
    OutputConflictError,
    PartitionValidationError,
    ProvenanceMismatchError,
    SourceResolutionError,
    UnsupportedBackendError,
    WorkflowSpecError,
)
from gridloom.operators.matching import SegmentationMetrics, compare_segmentations  # noqa: E402
from gridloom.run import load, open_array, open_result, plan, run  # noqa: E402
from gridloom.sources.archive import open_dandi  # noqa: E402
from gridloom.sources.base import open_source  # noqa: E402
from gridloom.spec import WorkflowSpec, reproduce  # noqa: E402

__all__ = [
    "AdapterCompatibilityError", "AmbiguousSelectionError", "GridloomError", "IncompletePartitionError", "NamedArray", "ObjectNotFoundError", "OutputConflictError",
    "PartitionValidationError", "ProvenanceMismatchError", "SegmentationMetrics", "SourceResolutionError", "UnsupportedBackendError", "WorkflowSpec", "WorkflowSpecError",
    "compare_segmentations", "load", "open_array", "open_dandi", "open_result", "open_source", "plan", "reproduce", "run",
]
