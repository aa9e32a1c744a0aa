"""Reward analytics over model rollouts, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from rewardloom.config import EngineConfig
from rewardloom.session import build_session

# Task functions travel with their jobs, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EngineConfig", "build_session"]
