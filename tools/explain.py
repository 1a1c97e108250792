"""Print the formatted physical plan of registered jobs.

    python tools/explain.py [--sf DIR] name [name ...]
"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import registry  # noqa: E402
from quarry.session import get_session  # noqa: E402

ap = argparse.ArgumentParser()
ap.add_argument("--sf", default="/root/testdata/sf0.1")
ap.add_argument("--mode", default="formatted")
ap.add_argument("names", nargs="+")
a = ap.parse_args()
spark = get_session("local[8]", 16)
for n in a.names:
    print(f"===== {n}")
    registry.queries()[n](spark, a.sf).explain(a.mode)
