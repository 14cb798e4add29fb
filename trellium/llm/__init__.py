"""Operators for building training corpora: filters, deduplication, scans, mixing and sharding.

What runs on the executors travels with the plan, by value, so they need no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
