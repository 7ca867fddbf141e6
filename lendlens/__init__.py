"""Loan-pricing analytics and deal prioritisation on Spark DataFrames.

Rules are functions ``Column -> Column`` (``lendlens.functions``), operators are
functions ``DataFrame -> DataFrame`` (``lendlens.operators``), layer builds are
lazy dictionaries of DataFrames (``lendlens.plans``).
"""

__version__ = "0.1.0"
