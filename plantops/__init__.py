"""plantops: production-planning and procurement datasets as Spark jobs.

Every public function takes DataFrames (or an :class:`~plantops.sources.Erp`
bundle of them) and returns a DataFrame.  Nothing is collected to the driver;
the plans are declarative so Catalyst and AQE choose the physical strategy.
"""

from plantops.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
