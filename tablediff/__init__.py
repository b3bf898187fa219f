"""tablediff: tells whether two copies of a dataset hold the same data, on Spark.

Main entry points::

    from tablediff import compare, compare_all, ComparisonSpec, Location, RowRange, Environment, Environments
"""

from .plans.compare import DatasetResult, compare, compare_all, run_verdict, validate_run
from .spec import ComparisonSpec, Environment, Environments, Location, RowRange, config_problems, run_from_dict, spec_from_dict

__all__ = [
    "ComparisonSpec",
    "DatasetResult",
    "Environment",
    "Environments",
    "Location",
    "RowRange",
    "compare",
    "compare_all",
    "config_problems",
    "run_from_dict",
    "run_verdict",
    "spec_from_dict",
    "validate_run",
]
