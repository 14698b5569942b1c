"""tallyloom: a Spark-first engine for retail price baskets.

The DataFrame operators live in :mod:`tallyloom.operators`, scalar expressions
in :mod:`tallyloom.functions`, readers in :mod:`tallyloom.sources`, whole plans
in :mod:`tallyloom.plans` and the incremental runtime in
:mod:`tallyloom.streaming`.  :mod:`tallyloom.llm` holds the training-data
operators; nothing else in the library imports it.
"""

__version__ = "0.1.0"
