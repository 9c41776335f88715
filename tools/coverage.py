"""Prints the inventory IDs and the queries that cover them (used for the README table)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lexiloom.plans.catalog import COVERS, ORACLES  # noqa: E402

by_id = {}
for name, ids in COVERS.items():
    for i in ids:
        by_id.setdefault(i, []).append(name + ("" if name in ORACLES else " (rows)"))
for i in sorted(by_id, key=lambda x: (x[0], int(x[1:]))):
    print(f"| {i} | {', '.join(f'`{n}`' for n in by_id[i])} |")
