"""failcast: device-failure forecasting over daily telemetry, as Spark DataFrame operators.

Every operator is ``DataFrame -> DataFrame`` (usable with ``df.transform``) and
stays inside Spark: no driver collection of data, no Python UDF on the data path.
"""

__version__ = "0.1.0"
