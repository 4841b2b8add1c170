"""Part of stormledger: natural-hazard event analytics on Spark."""
