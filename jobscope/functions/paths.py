"""Identifiers taken from file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def executor_id_from_path(path: Column) -> Column:
    """``…/executor_7/metrics`` → ``7``; null unless a directory name starts with ``executor_``.

    Folders of a partitioned table, ``…/executor_id=7/…``, are understood too.
    """
    found = F.regexp_extract(path, r"(?:^|/)executor_(?:id=)?([^/]+)(?:/|$)", 1)
    return F.when(found != "", found)


def app_id_from_sample_path(path: Column) -> Column:
    """The directory above that of the executor."""
    found = F.regexp_extract(path, r"(?:^|/)(?:app_id=)?([^/]+)/executor_[^/]+(?:/|$)", 1)
    return F.when(found != "", found)


def app_id_from_log_path(path: Column) -> Column:
    """Application id of an event log, rolling (``eventlog_v2_<app>/events_…``) or single file."""
    rolling = F.regexp_extract(path, r"/eventlog_v2_([^/]+)/", 1)
    single = F.regexp_extract(path, r"([^/]+?)(?:\.inprogress)?(?:\.(?:zstd|lz4|snappy|lzf))?$", 1)
    return F.when(rolling != "", rolling).otherwise(single)
