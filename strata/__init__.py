"""strata: a Spark-native engine for supervised work on one flat table.

Given a DataFrame and a target column it profiles every column, detects the
task type, builds the tables behind an exploratory report, cleans, imputes,
scales and encodes features, compares MLlib models by leak-free stratified
cross-validation, explains the winner, searches declarative features and keeps
every run as queryable log tables.  All data work is expressed with the
DataFrame / SQL / ML APIs; only small statistics reach the driver.
"""

from strata.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
