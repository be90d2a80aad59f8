"""shiftwise: workforce, warehouse and text analytics as Spark DataFrame operators.

Every public operator is a function from DataFrames (plus plain parameters) to
DataFrames.  Nothing is computed on the driver: the functions only declare
logical plans and let Catalyst/AQE choose the physical strategy.
"""

from shiftwise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
