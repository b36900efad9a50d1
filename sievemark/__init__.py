"""Finding, ranking and auditing past resolutions of recurring failures, on Spark."""
