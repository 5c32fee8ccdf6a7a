"""Quality rules: text statistics as expressions, and decision lists learned by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import SPACE, text_of

# At most so many labelled rows fit a list; chosen by the smallest hashes of their keys.
LABELLED = 20_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# What the learned conditions compare, from the statistics and the number of lines.
FEATURES = {
    "n_words": "CAST(n_words AS double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five statistics and `_lines` (lines with a word) of every whole text.

    All of it is built-in expressions over one row's arrays: no shuffle, and no row is explained twice. A repeated
    window is found by sorting the hashes of a text's windows with their places, so a long text costs n log n.
    Null text is empty: all counts 0. Repeated rows give repeated results.
    """
    whole = docs.select(docs[key].alias(key), text_of(docs, text).alias("_text"))
    words = F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    step = whole.select(
        key, words.alias("_words"), lines.alias("_full"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    w = F.col("_words")
    # The last two would be windows of fewer words.
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    step = step.select(
        key, "n_symbols", hashes.alias("_hashes"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_words").cast("long").alias("n_words"),
        F.size("_full").cast("long").alias("_lines"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
    )
    # Only texts in which some window occurs again need their windows sorted.
    windows = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_windows", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), windows)).drop("_hashes")
    s = F.col("_windows")
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    step = step.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_windows")
    p = F.col("_again")
    fresh = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(fresh, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long")
    # Generated, not projected: else a filter on a statistic would be moved below and work it out for every word again.
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "_lines")
    return step.select(key, F.inline(F.array(found)))


def base_failed() -> Column:
    """Too short, or more than half of the words repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def chosen_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality", bound: int = LABELLED) -> DataFrame:
    """(key, label, order) of at most `bound` labelled rows, those with the smallest hashes of their keys."""
    known = labels.select(labels[key].alias(key), labels[label].cast("int").alias("label"), F.xxhash64(labels[key]).alias("order"))
    return known.filter(f"{key} is not null and label is not null").orderBy("order").limit(bound)


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", bound: int = LABELLED, precision: float = 0.98, support: int = 5) -> list[Rule]:
    """Rules that name bad documents, in the order they were found.

    `stats` are rows of `statistics`; those that the base limits reject teach nothing. The labelled rows are bounded by `bound`; only their numbers come to the driver.
    """
    chosen = chosen_labels(labels, key, label, bound)
    own = stats.filter(~base_failed()).select(stats[key].alias("_key"), *[F.expr(c).alias(f) for f, c in FEATURES.items()])
    rows = chosen.join(own, chosen[key] == own["_key"]).drop(key, "_key").orderBy("order").limit(bound).collect()
    values = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    bad = np.array([r["label"] == 0 for r in rows], bool)
    held = np.array([r["order"] % 3 == 0 for r in rows], bool)  # a third prunes and tests what the rest has grown
    return covering(values, bad, held, precision, support)


def covering(values: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, precision: float, support: int) -> list[Rule]:
    """Sequential covering: grow a conjunction on one part, prune it on the other, keep it if it is precise, remove what it covers."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while (left & bad).any():
        rule = _grown(values, bad, left & ~held)
        rule = _pruned(rule, values, bad, left & held)
        if not rule:
            break
        covers = left & _all(rule, values)
        right, everything = int((covers & bad).sum()), int(covers.sum())
        tested = covers & held
        if right < support or right < precision * everything or (tested & bad).sum() < precision * tested.sum():
            break
        rules.append(rule)
        left &= ~covers
    return rules


def _all(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    holds = np.ones(len(next(iter(values.values()))), bool)
    for condition in rule:
        holds &= condition.holds(values)
    return holds


def _grown(values: dict[str, np.ndarray], bad: np.ndarray, among: np.ndarray, cuts: int = 64) -> Rule:
    """Add the condition of the highest information gain until no good row is covered or nothing gains."""
    rule: list[Condition] = []
    now = among.copy()
    while (now & ~bad).any() and (now & bad).any():
        before = np.log2((now & bad).sum() / now.sum())
        best, most = None, 1e-9
        for feature, numbers in values.items():
            # Thresholds lie between neighbouring values, so rounding does not move a row across.
            points = np.unique(np.quantile(numbers[now], np.linspace(0, 1, cuts + 1), method="lower"))
            for a, b in zip(points, points[1:]):
                for above in (True, False):
                    condition = Condition(feature, above, float((a + b) / 2))
                    kept = now & condition.holds(values)
                    p, n = int((kept & bad).sum()), int(kept.sum())
                    gain = p * (np.log2(p / n) - before) if p else 0.0
                    if gain > most:
                        best, most = condition, gain
        if best is None:
            break
        rule.append(best)
        now &= best.holds(values)
    return tuple(rule)


def _pruned(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, among: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the highest (right - wrong) / covered on the part held back."""

    def worth(length: int) -> float:
        covers = among & _all(rule[:length], values)
        return (2 * (covers & bad).sum() - covers.sum()) / max(1, covers.sum())

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))] if rule else rule


def rejected(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression over rows of `statistics`: the first rule that holds rejects."""
    verdict = F.lit(False)
    for rule in reversed(rules):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        verdict = F.when(holds, F.lit(True)).otherwise(verdict)
    return verdict


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """`stats` with base_failed and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(rules))


def kept_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = LABELLED) -> DataFrame:
    """The rows of `docs` that the base limits and the learned list keep.

    The list is learned from the labelled documents alone, picked by the hash of their keys before any
    statistic is worked out; the verdict is an expression beside the text, so texts are not shuffled. Without
    labels only the base limits count. Null text fails them (no words).
    """
    # At most `bound` keys, so they can go to every task.
    chosen = chosen_labels(labels, key, label, bound).select(F.col(key).alias("_chosen"))
    known = docs.join(F.broadcast(chosen), docs[key] == F.col("_chosen"), "left_semi")
    rules = learn(statistics(known, key, text), labels, key, label, bound)
    # Statistics beside the whole row: the row is one struct, so its column names cannot clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    judged = judge(statistics(rows, "row", "text"), rules)
    return judged.filter("kept").select("row.*")
