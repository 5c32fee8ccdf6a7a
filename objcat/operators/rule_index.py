"""Very many ordered rules as a table: each rule is filed under one key, and a path meets the rules of the few keys it holds."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objcat.operators import globs

GRAM = 4  # characters of a piece of text that is a key
# Words are runs of ASCII letters and digits, in a path as in a pattern.
WORD = "[0-9A-Za-z]+"
_BEFORE, _AFTER = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"


def rule_keys(pieces: list[tuple], anchored: bool) -> set[str]:
    """Keys that every path matched by the pattern holds: whole words of its text (`w…`), and pieces of GRAM characters (`g…`).

    A word at an end of a text is whole only where nothing else can stand beside it: at the end of the pattern, and, where the pattern
    starts at a component, at its start.
    """
    found: set[str] = set()
    for place, (kind, text) in enumerate(pieces):
        if kind != "text":
            continue
        found |= {"g" + text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
        for word in re.finditer(f"{_BEFORE}{WORD}{_AFTER}", text, re.ASCII):
            opens = word.start() > 0 or place == 0 and anchored
            closes = word.end() < len(text) or place == len(pieces) - 1
            if opens and closes:
                found.add("w" + word[0])
    return found


def path_keys(path: Column, grams: bool) -> Column:
    """The keys that a path holds, pieces without their sign: a word that looks like one only meets more rules, which are tested."""
    words = F.transform(F.regexp_extract_all(path, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.concat(F.lit("w"), w))
    if not grams:
        return F.array_distinct(words)
    # A look ahead at each place: overlapping pieces from one pass.
    pieces = F.regexp_extract_all(path, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.array_distinct(F.concat(words, pieces))


class RuleIndex:
    """Ordered rules, of which the first that matches a path decides.

    A rule whose test stands earlier in the list never decides and is left out. Each other one is filed under that of its keys
    which fewest rules share. Rules without a key (wildcards, very short texts) are tested
    on every path, in groups that one regular expression covers.
    """

    def __init__(self, rules):
        first: dict[tuple[str, bool], tuple] = {}
        for position, rule in enumerate(rules, start=1):
            first.setdefault((rule.regex(), rule.directories_only), (position, rule))
        keys = [rule_keys(rule.pieces, anchored=True) for _, rule in first.values()]
        common = Counter(key for some in keys for key in some)
        self.filed, self.loose = [], []
        for (position, rule), some in zip(first.values(), keys):
            if some and not rule.matches_everything():
                key = min(some, key=lambda k: (common[k], k[0], k))
                longest = max(globs.literals(rule.pieces), key=len)
                self.filed.append((position, rule.action, rule.directories_only, key, longest, "(?s)" + rule.regex()))
            else:
                self.loose.append((position, rule))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(*filed[:3], filed[3].removeprefix("g"), *filed[4:]) for filed in self.filed]
        return spark.createDataFrame(rows, "_position int, _action string, _dirs boolean, _key string, _text string, _regex string")

    def _loose_match(self, path: Column, is_dir: Column | bool) -> Column:
        """(position, action) of the first rule without a key that matches, or NULL."""
        found = F.lit(None).cast("struct<_position:int,_action:string>")
        for position, rule in reversed(self.loose):
            verdict = F.struct(F.lit(position).alias("_position"), F.lit(rule.action).alias("_action"))
            found = F.when(rule.predicate(path, is_dir), verdict).otherwise(found)
        return found

    def first_match(self, inv: DataFrame, is_dir: Column | bool = False) -> DataFrame:
        """Every row with `_first`: the position and action of the rule that decides it, NULL where none matches.

        Paths are split to keys where they are read and meet the rule table, which is sent to them, in an equi-join. What a rule's text and regular expression
        confirm is reduced to the least position per path before it is moved; position and action are one number there, as a
        struct would be sorted for it. Work grows with the rules that share a key with a path,
        not with their number. Whether a row is a directory is looked at only if some rule asks for it.
        """
        directional = any(filed[2] for filed in self.filed) and is_dir is not False
        place = [F.col("path")] + ([is_dir.alias("_is_dir")] if directional else [])
        names = ["path", "_is_dir"] if directional else ["path"]
        grams = any(filed[3].startswith("g") for filed in self.filed)
        rows = inv.select(*place).select(*names, F.explode(path_keys(F.col("path"), grams)).alias("_key"))
        met = rows.join(F.broadcast(self.table(inv.sparkSession)), "_key")
        fits = F.contains("path", "_text") & F.expr("path RLIKE _regex")
        fits = fits & (~F.col("_dirs") | F.col("_is_dir")) if directional else fits & ~F.col("_dirs")
        actions = F.array(*[F.lit(a) for a in sorted({filed[1] for filed in self.filed}) or [""]])
        packed = F.col("_position").cast("long") * F.size(actions) + F.array_position(actions, F.col("_action")) - 1
        best = met.filter(fits).groupBy(*names).agg(F.min(packed).alias("_packed"))
        best = best.withColumnsRenamed({n: f"{n}_" for n in names})
        on = inv["path"] == best["path_"]
        if directional:
            on = on & (is_dir == best["_is_dir_"])
        loose = self._loose_match(F.col("path"), is_dir)
        position = F.call_function("div", F.col("_packed"), F.size(actions).cast("long"))
        action = F.get(actions, (F.col("_packed") % F.size(actions)).cast("int"))
        filed = F.when(F.col("_packed").isNotNull(), F.struct(position.cast("int").alias("_position"), action.alias("_action")))
        return inv.join(best, on, "left").withColumn("_first", F.least(filed, loose)).select(*inv.columns, "_first")
