from barloom.suite.base import ORACLES, QUERIES
from barloom.suite import analytics, live, market, signals, studies, sweeps

__all__ = ["ORACLES", "QUERIES"]
