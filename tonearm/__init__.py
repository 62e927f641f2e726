"""tonearm: music-catalogue analytics as PySpark jobs.

Every operator takes DataFrames and returns a DataFrame.  Nothing is collected
to the driver; see README.md for the layout and the scaling notes.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# executors need no installed copy of this package: its functions travel with the task
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
