"""Print the query names of one workload module."""

import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
print(*importlib.import_module(f"workload.{sys.argv[1]}").QUERIES)
