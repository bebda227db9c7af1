"""Spark-native feature engine for business-process event logs."""

from caselog.log import EventLog, case_profile, case_table

__all__ = ["EventLog", "case_profile", "case_table"]
