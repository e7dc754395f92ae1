"""Maximum-entropy null models of weighted directed networks on PySpark DataFrames."""

__version__ = "0.1.0"
