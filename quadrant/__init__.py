"""quadrant: campus-scale to planet-scale map, timetable and text analytics as PySpark plans."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers whole, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
