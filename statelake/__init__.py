"""statelake: last-write-wins state tables as Spark jobs."""

import sys

from pyspark import cloudpickle

from statelake.session import get_session

# task functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
