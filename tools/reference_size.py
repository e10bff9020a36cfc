"""One fit at the reference's size (20 members of 20 trees), timed and held against its saved trees.

usage: python tools/reference_size.py [sf_dir]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from failcast.plans.driver_queries import reference_size_trees  # noqa: E402
from failcast.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
begin = time.time()
print(reference_size_trees(get_session("reference-size"), sf).first().asDict(), round(time.time() - begin), "s")
