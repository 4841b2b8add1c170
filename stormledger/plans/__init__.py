"""Part of stormledger: natural-hazard event analytics on Spark."""

from . import catalogue, experiments, exposure, feeds, policies, products, records, shapes, tracks  # noqa: F401  (the others add their queries to the catalogue's)
