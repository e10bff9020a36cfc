"""DataFrame -> DataFrame operators: features, labels, sampling, alerts, metrics, ensemble."""

from failcast.operators import alerts, ensemble, features, labels, metrics, sampling  # noqa: F401
