"""Probability-of-default analytics expressed as Spark DataFrame operators."""

__version__ = "0.1.0"

import os

# Starting the JVM forks this process, after which a threaded OpenBLAS may wait for its threads
# for ever. Numpy works on small matrices here, and tasks share their cores, so one thread is right.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
