"""Retail event analytics as DataFrame-to-DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

from shelfstream.session import build_session, tune

# Code used inside tasks travels with them, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "tune"]
