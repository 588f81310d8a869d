"""tidewatch: corpus-scale code and text security findings on Spark.

Source files (or any table with a text column) go in; fact tables, findings,
summaries, reports and verdict/statistics tables come out.  Every operator is a
DataFrame -> DataFrame function; see README.md for the map.
"""

from tidewatch.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
