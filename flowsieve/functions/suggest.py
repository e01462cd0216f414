"""Names close to a mistyped one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dropclass import CLASS_OF, VALID_REASONS


def closest(typed: DataFrame, column: str = "typed", n: int = 5) -> DataFrame:
    """The rows of ``typed`` (a row for each name), each with up to ``n`` valid reasons by edit distance, then name: name, distance and place (from 1).

    None is further than half the typed length and two (ten at most); names without one have no row. The valid reasons are a fixed list of 76, so each name is held against
    all of them where it is."""
    far = F.least(F.lit(10), F.expr(f"octet_length(`{column}`) div 2 + 2"))
    near = F.transform(F.array(*[F.lit(r) for r in VALID_REASONS]), lambda r: F.struct(F.levenshtein(F.col(column), r).alias("distance"), r.alias("name")))
    best = F.slice(F.array_sort(F.filter(near, lambda x: x["distance"] <= far)), 1, n)
    return typed.select("*", F.posexplode(best).alias("place", "near")).select(*typed.columns, "near.name", "near.distance", (F.col("place") + 1).alias("place"))


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def check_reasons(typed: Sequence[str]) -> tuple[list[str], list[str]]:
    """Upper-cased drop reasons to ignore, and warnings for those that never make a policy anyway. Raises for unknown ones, with suggestions."""
    names, warnings = [t.strip().upper() for t in typed], []
    for name in names:
        if name not in CLASS_OF:
            far = min(10, len(name) // 2 + 2)
            near = sorted((d, c) for c in VALID_REASONS if (d := _distance(name, c)) <= far)[:5]
            raise ValueError(f"unknown drop reason {name!r}" + (f"; did you mean: {', '.join(c for _, c in near)}?" if near else ""))
        if CLASS_OF[name] in ("infra", "transient"):
            warnings.append(f"{name} is a {CLASS_OF[name]} reason and makes no policy")
    return names, warnings
