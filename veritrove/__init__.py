"""Scientific-integrity analytics as Spark column expressions and grouped aggregates."""

__version__ = "0.1.0"
