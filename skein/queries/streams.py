"""Batch forms of the windowed extras."""

from __future__ import annotations

from skein.storage import read_table
from skein.streaming.windows import hourly_counts, sessions


def y01_hourly(spark, sf):
    return hourly_counts(read_table(spark, sf, "events"))


def y02_sessions(spark, sf):
    return sessions(read_table(spark, sf, "events"))


def queries() -> dict:
    return {"y01_hourly": y01_hourly, "y02_sessions": y02_sessions}


def oracle_sql() -> dict:
    return {
        "y01_hourly": "select date_trunc('hour', ts) as hour, event_type, count(*) n from events group by 1, 2",
        "y02_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end s from events window w as (partition by user_id order by ts)), n as (select *, sum(s) over (partition by user_id order by ts) k from g) select user_id, min(ts) began, count(*) n_events from n group by user_id, k",
    }
