"""Text-to-SQL data preparation and answer scoring as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from quillon.session import build_session, scratch_path

# Python functions of this package travel to the workers by value, so that a job runs whether
# or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_path"]
