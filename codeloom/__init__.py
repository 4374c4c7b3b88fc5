"""codeloom: code-graph and agent-log analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from codeloom.session import build_session, materialize, scratch_dir

# Functions run in tasks travel with the plan, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "materialize", "scratch_dir"]
__version__ = "0.1.0"
