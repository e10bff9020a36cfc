from failcast.functions.expressions import (  # noqa: F401
    day_number, hash_order, log2p1, month_key, parse_day, weighted_total,
)
