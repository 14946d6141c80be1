"""Print which registered queries cover which inventory rows."""

from __future__ import annotations

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chartloom.plans.registry import all_queries  # noqa: E402


def main() -> None:
    rows = defaultdict(list)
    for q in all_queries().values():
        for row in q.covers:
            rows[row].append(q.name + ("" if q.sql else " (no SQL)"))
    for row in sorted(rows, key=lambda r: (r[0], int(r[1:]))):
        print(f"{row:4s} {', '.join(rows[row])}")


if __name__ == "__main__":
    main()
