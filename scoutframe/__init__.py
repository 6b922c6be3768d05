"""scoutframe: Spark operators for entity-period panels, odds and portfolios."""

__version__ = "0.1.0"
