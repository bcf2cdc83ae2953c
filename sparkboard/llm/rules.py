"""Quality rules: a learned decision list over text statistics.

Sequential covering: a rule is grown on two thirds of the labelled rows, threshold by threshold, by the
gain of information about the rows to drop; pruned on the other third, from its end, while that makes it
more precise there; kept if it is precise and covers enough, else learning stops. The rows a rule covers
are set aside before the next one is grown. The list is emitted as one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.llm.shared import smallest_hash
from sparkboard.llm.stats import features

#: Labelled rows a model is fitted on, at most.
LABELLED = 20_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def every(conditions: Rule) -> Column:
    result = conditions[0].column()
    for c in conditions[1:]:
        result &= c.column()
    return result


def labelled(stats: DataFrame, labels: DataFrame, label: str, rows: int = LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and labels of at most `rows` rows, those with the smallest hashes of their id.

    `stats` has id and the counts of `statistics`, `labels` id and the label (0, 1; others are passed over).
    """
    known = labels.where(f"`{label}` in (0, 1)").select("id", F.col(label).cast("int").alias("__y"))
    table = stats.join(known, "id").select("id", "__y", *[c.alias(n) for n, c in features().items()])
    found = smallest_hash(table, ["id", "__y"], rows, known.count()).collect()
    x = {n: np.array([r[n] for r in found], float) for n in features()}
    return x, np.array([r["__y"] for r in found], int)


def candidates(values: np.ndarray, most: int = 32) -> np.ndarray:
    """Thresholds halfway between neighbouring values, spread evenly over the rows."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return distinct[:0]
    picked = np.unique(np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, most + 1))))
    picked = picked[picked < len(distinct) - 1]
    picked = np.unique(np.concatenate([picked, np.linspace(0, len(distinct) - 2, min(most, len(distinct) - 1)).astype(int)]))
    return (distinct[picked] + distinct[picked + 1]) / 2


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    result = np.ones(n, bool)
    for c in rule:
        result &= c.holds(x[c.feature])
    return result


def grown(x: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None, None)
        for name, values in x.items():
            for cut in candidates(values[inside]):
                for above in (True, False):
                    held = inside & ((values > cut) if above else (values <= cut))
                    q, m = (bad & held).sum(), (~bad & held).sum()
                    if q and (gain := q * (np.log2(q / (q + m)) - base)) > best[0]:
                        best = gain, Condition(name, above, float(cut)), held
        if best[1] is None:
            break
        rule, inside = (*rule, best[1]), best[2]
    return rule


def learned(x: dict[str, np.ndarray], good: np.ndarray, precise: float = 0.95, least: int = 3, most: int = 20) -> list[Rule]:
    """Ordered rules for the rows to drop. Without a row of either label: none."""
    rng = np.random.default_rng(3)
    bad, rules = good == 0, []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (bad & left).any() and (~bad & left).any():
        growing = rng.random(len(bad)) < 2 / 3
        g, p = left & growing, left & ~growing
        if not (bad & g).any():
            break
        rule = grown({n: v[g] for n, v in x.items()}, bad[g])
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            held = covered(r, x, len(bad)) & p
            hits, misses = (bad & held).sum(), (~bad & held).sum()
            return ((hits - misses) / (hits + misses) if hits + misses else -1.0, -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        held = covered(rule, x, len(bad)) & left
        if (bad & held).sum() < least or (bad & held).sum() < precise * held.sum():
            break
        rules.append(rule)
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an expression on a table of `statistics`: true for rows to keep."""
    result = F.lit(True)
    for rule in reversed(rules):
        result = F.when(every(rule), F.lit(False)).otherwise(result)
    return result


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed and kept; a text that fails the base is not kept whatever the rules say."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
