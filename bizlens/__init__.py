"""bizlens: business analytics on Spark DataFrames.

Every operator is ``DataFrame -> DataFrame``; options are keyword-only and
``by`` (grouping keys) computes every company / region / product in one job.
"""

from bizlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
