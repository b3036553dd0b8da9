"""Point-in-time bar and ledger analytics on Spark DataFrames."""

from pitbars.session import build_session, checkpointed, prepare

__all__ = ["build_session", "checkpointed", "prepare"]

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
