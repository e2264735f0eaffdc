"""panelforge: formula queries over time x asset panels, on PySpark."""

__version__ = "0.1.0"
