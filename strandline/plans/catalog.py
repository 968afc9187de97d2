"""All registered queries; importing this module fills the registry."""

from strandline.plans import (  # noqa: F401
    arrays,
    chains,
    codes,
    evaluation,
    linkage,
    modelling,
    prediction_sets,
    relations,
    scalars,
    scans,
    trees,
)
from strandline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
