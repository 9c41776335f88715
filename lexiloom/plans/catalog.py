"""Imports every plan module so that its queries are registered."""

from lexiloom.plans import alignment, audit, corpora, dedup, flows, graphs, lexical, scalars, searching, segmentation  # noqa: F401
from lexiloom.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
