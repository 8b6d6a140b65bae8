"""Security-findings analytics as Spark jobs: read, normalise, correlate, search, guard and evaluate."""

__version__ = "0.1.0"
