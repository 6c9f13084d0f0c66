"""Operator ids against the queries that exercise them."""

from __future__ import annotations

from checks import all_queries

FAMILIES = {"S": 16, "T": 28, "P": 22, "F": 21, "J": 16, "A": 41, "W": 21, "K": 10, "D": 3, "C": 31, "B": 25}


def covered() -> dict[str, list[str]]:
    from checks.registry import COVERS

    all_queries()
    out: dict[str, list[str]] = {f"{f}{i}": [] for f, n in FAMILIES.items() for i in range(1, n + 1)}
    for name, ids in COVERS.items():
        for i in ids:
            out[i].append(name)
    return out


def missing() -> list[str]:
    return [i for i, names in covered().items() if not names]


if __name__ == "__main__":
    for i, names in covered().items():
        print(i, ", ".join(names))
    print("missing", missing())
