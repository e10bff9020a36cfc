from failcast.streaming.alert_stream import DailyAlertStream  # noqa: F401
