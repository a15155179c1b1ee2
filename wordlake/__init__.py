"""wordlake: text and engagement analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (or Columns) and returns DataFrames
(or Columns); nothing is collected to the driver except bounded results
(model parameters, bin tables, k x k matrices, top-k answers).
"""

from wordlake.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
__version__ = "0.1.0"
