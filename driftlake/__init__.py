"""driftlake: API-contract inference, drift and promotion analytics on Spark."""

import sys

from pyspark import cloudpickle

from driftlake.session import build_session, scratch_folder

# Python functions of this package travel inside the tasks; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_folder"]
