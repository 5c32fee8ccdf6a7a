"""Ordered include/exclude rules with size, age, depth and list limits, compiled to column expressions."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions import paths, units
from objcat.operators import globs
from objcat.operators.rule_index import RuleIndex

INCLUDE, EXCLUDE = "include", "exclude"

# How a line of a rule file starts.
MARKERS = {"+": INCLUDE, "-": EXCLUDE}
CLEAR = "!"
COMMENTS = ("#", ";")

# Alternatives put into one regular expression.
RULES_PER_REGEX = 100

# Changes of action that are nested as and/or; with more of them the tests stand in one flat list.
DEEPEST = 40

# Rules that are tested as expressions; more of them are a table that paths are joined with, to the same result.
EXPRESSIONS = 500


@dataclass(frozen=True)
class Rule:
    """One rule. A leading `/` anchors at the root, a pattern without `/` tests the file name, any other
    pattern tests the path and its tails; a trailing `/` restricts the rule to directories."""

    action: str
    pattern: str
    pieces: list = field(init=False, compare=False, repr=False)
    anchor: str = field(init=False, compare=False)
    directories_only: bool = field(init=False, compare=False)

    def __post_init__(self):
        body = globs.composed(self.pattern)
        directories_only = body.endswith("/")
        body = body[:-1] if directories_only else body
        anchor = "root" if body.startswith("/") else "suffix" if "/" in body else "name"
        body = body[1:] if anchor == "root" else body
        object.__setattr__(self, "pieces", globs.read_glob(body))
        object.__setattr__(self, "anchor", anchor)
        object.__setattr__(self, "directories_only", directories_only)

    def predicate(self, path: Column, is_dir: Column | bool = False) -> Column:
        if self.directories_only and is_dir is False:
            return F.lit(False)
        test = {"root": globs.whole_match, "name": globs.name_match, "suffix": globs.suffix_match}[self.anchor]
        matched = F.lit(True) if self.matches_everything() else test(path, self.pieces)
        if self.directories_only and not isinstance(is_dir, bool):
            return is_dir & matched
        return matched

    def matches_everything(self) -> bool:
        kinds = [kind for kind, _ in self.pieces]
        return kinds == [globs.GLOBSTAR] or (self.anchor == "name" and kinds == [globs.STAR])

    def regex(self) -> str:
        """The whole test as one regular expression over the path."""
        if self.anchor == "root":
            return rf"\A{globs.pieces_regex(self.pieces)}\z"
        if self.anchor == "name":
            return rf"(?:\A|/){globs.pieces_regex(self.pieces, one_component=True)}\z"
        return rf"\A(?:.*/)?(?:{globs.pieces_regex(self.pieces)})\z"

    def above_regex(self) -> str:
        """A regular expression that finds this rule matching some directory above a path."""
        if self.anchor == "root":
            return rf"\A{globs.pieces_regex(self.pieces)}/"
        if self.anchor == "name":
            return rf"(?:\A|/){globs.pieces_regex(self.pieces, one_component=True)}/"
        return rf"\A(?:.*/)?(?:{globs.pieces_regex(self.pieces)})/"

    def matches_root(self) -> bool:
        """Whether the unnamed root directory itself matches."""
        return re.fullmatch(
            re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", globs.pieces_regex(self.pieces)),
            "",
            re.S,
        ) is not None


def rule_lines(text: str) -> list[tuple[str, str] | None]:
    """Rules of a rule file as (action, pattern); None stands for the line that clears what came before."""
    found: list[tuple[str, str] | None] = []
    for number, raw in enumerate(text.splitlines(), start=1):
        line = raw.strip()
        if not line or line.startswith(COMMENTS):
            continue
        if line == CLEAR:
            found.append(None)
            continue
        action, rest = MARKERS.get(line[0]), line[1:]
        if action is None or (rest and not rest[0].isspace()):
            raise Refused(f"line {number}: {line!r}: a rule begins with '+ ' or '- '")
        if not rest.strip():
            raise Refused(f"line {number}: {line!r}: nothing stands after the sign")
        found.append((action, rest.strip()))
    return found


def pattern_lines(text: str) -> list[str]:
    """Patterns of an include or exclude file, one per line."""
    stripped = (raw.strip() for raw in text.splitlines())
    return [line for line in stripped if line and not line.startswith(COMMENTS)]


def _scalar(expression: Column) -> object:
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate().range(1).select(expression.alias("v")).first()["v"]


def _size_bound(value: int | str | None, flag: str) -> int | None:
    if value is None or isinstance(value, int):
        return value
    if value.strip() and not re.search("[A-Za-z]", value):
        raise Refused(f"{flag}: {value!r} needs a unit such as K, M or G")
    parsed = _scalar(units.parse_size(F.lit(value)))
    if parsed["problem"]:
        raise Refused(f"{flag}: {value!r} is not a size ({parsed['problem']})")
    return parsed["bytes"]


def _age_bound(value: int | str | None, flag: str) -> int | None:
    if value is None or isinstance(value, int):
        return value
    parsed = _scalar(units.parse_age(F.lit(value)))
    if parsed["problem"]:
        raise Refused(f"{flag}: {value!r} is not an age ({parsed['problem']})")
    return parsed["seconds"]


@dataclass(frozen=True)
class FilterSet:
    """What a listing keeps. The first rule that matches decides; without a match, the default does."""

    rules: tuple[Rule, ...] = ()
    default: str = INCLUDE
    min_size: int | None = None
    max_size: int | None = None
    oldest: int | None = None
    newest: int | None = None
    max_depth: int | None = None
    only: DataFrame | None = None

    @classmethod
    def build(
        cls,
        include: list[str] = (),
        include_from: list[str] = (),
        exclude: list[str] = (),
        exclude_from: list[str] = (),
        rules: list[str] = (),
        rules_from: list[str] = (),
        only: DataFrame | None = None,
        min_size: int | str | None = None,
        max_size: int | str | None = None,
        min_age: int | str | None = None,
        max_age: int | str | None = None,
        max_depth: int = -1,
        now: int | None = None,
    ) -> FilterSet:
        """Collect inputs in their fixed order: include, include file, exclude, exclude file, rule line, rule file.

        `*_from` take file contents. Any include input appends `- **` and turns the default to exclude.
        """
        ordered: list[Rule] = [Rule(INCLUDE, p) for p in include]
        ordered += [Rule(INCLUDE, p) for text in include_from for p in pattern_lines(text)]
        ordered += [Rule(EXCLUDE, p) for p in exclude]
        ordered += [Rule(EXCLUDE, p) for text in exclude_from for p in pattern_lines(text)]
        for text in (*rules, *rules_from):
            for entry in rule_lines(text):
                if entry is None:
                    ordered.clear()
                else:
                    ordered.append(Rule(*entry))
        closed = bool(include) or bool(include_from)
        if closed:
            ordered.append(Rule(EXCLUDE, "**"))

        low, high = _size_bound(min_size, "min_size"), _size_bound(max_size, "max_size")
        if low is not None and high is not None and low > high:
            raise Refused(f"min_size ({low} bytes) is larger than max_size ({high} bytes)")
        young, old = _age_bound(min_age, "min_age"), _age_bound(max_age, "max_age")
        if young is not None and old is not None and young > old:
            raise Refused(f"min_age ({young} seconds) is longer than max_age ({old} seconds)")
        if max_depth < -1:
            raise Refused(f"max_depth must be -1 (no limit) or more, got {max_depth}")
        now = int(time.time()) if now is None else now
        return cls(
            rules=tuple(ordered),
            default=EXCLUDE if closed else INCLUDE,
            min_size=low,
            max_size=high,
            oldest=None if old is None else now - old,
            newest=None if young is None else now - young,
            max_depth=None if max_depth == -1 else max_depth,
            only=only,
        )

    def with_depth(self, limit: int | None) -> FilterSet:
        return replace(self, max_depth=limit)

    @property
    def restricting(self) -> bool:
        limits = (self.min_size, self.max_size, self.oldest, self.newest, self.max_depth)
        return bool(self.rules) or self.only is not None or any(x is not None for x in limits)

    # -- expressions ---------------------------------------------------------------------------------

    def _is_dir(self, df: DataFrame) -> Column | bool:
        return F.col("is_dir") if "is_dir" in df.columns else False

    def _limit_reasons(self, df: DataFrame) -> list[tuple[Column, str]]:
        """(broken limit, reason) in the order the limits are tried: depth, age, size. Unknown values pass."""
        tests: list[tuple[Column, str]] = []
        if self.max_depth is not None:
            tests.append((paths.depth("path") > self.max_depth, "too-deep"))
        if self.oldest is not None:
            tests.append((F.col("mtime") < self.oldest, "too-old"))
        if self.newest is not None:
            tests.append((F.col("mtime") > self.newest, "too-new"))
        if self.min_size is not None:
            tests.append((F.col("size") < self.min_size, "too-small"))
        if self.max_size is not None:
            tests.append((F.col("size") > self.max_size, "too-large"))
        return tests

    def rules_admit(self, path: Column, is_dir: Column | bool = False) -> Column:
        """Outcome of the rules alone. Neighbouring rules with one action are one test, so the expression
        grows with the changes of action, not with the number of rules."""
        runs: list[tuple[str, list[Rule]]] = []
        for rule in self.rules:
            if runs and runs[-1][0] == rule.action:
                runs[-1][1].append(rule)
            else:
                runs.append((rule.action, [rule]))
        groups = [(action, _tests(rules, path, is_dir)) for action, rules in runs]
        while groups and groups[-1][0] == self.default:
            groups.pop()
        # From the last group to the first: an include lets in what it matches and whatever the rest lets in,
        # an exclude keeps out what it matches. Plain and/or, so that what the scan can test reaches it.
        admits = F.lit(self.default == INCLUDE)
        if len(groups) > DEEPEST:
            decided = F.when(F.lit(False), F.lit(False))
            for action, tests in groups:
                decided = decided.when(_any(tests), F.lit(action == INCLUDE))
            return decided.otherwise(admits)
        for action, tests in reversed(groups):
            admits = _any(tests) | admits if action == INCLUDE else ~_any(tests) & admits
        return admits

    def limits_admit(self, df: DataFrame) -> Column:
        """Size, age and depth limits; each is a plain range test that also lets NULL through."""
        kept = F.lit(True)
        for column, low, high in (("size", self.min_size, self.max_size), ("mtime", self.oldest, self.newest)):
            if low is not None or high is not None:
                inside = F.lit(True) if low is None else F.col(column) >= low
                inside = inside if high is None else inside & (F.col(column) <= high)
                kept = kept & (F.col(column).isNull() | inside)
        if self.max_depth is not None:
            kept = kept & (paths.depth("path") <= self.max_depth)
        return kept

    def admitted(self, df: DataFrame) -> Column:
        """Whether a row passes everything but the path list, which needs a join."""
        return self.limits_admit(df) & self.rules_admit(F.col("path"), self._is_dir(df))

    # -- operators -----------------------------------------------------------------------------------

    def _decided(self, inv: DataFrame) -> DataFrame:
        """Every row with `_first`, the position and action of the first rule that matches, by a join with the rules."""
        return RuleIndex(self.rules).first_match(inv, self._is_dir(inv))

    def _by_table(self, df: DataFrame) -> Column:
        """Over `_decided` rows, whether limits and rules let a row pass."""
        return self.limits_admit(df) & (F.coalesce(F.col("_first._action"), F.lit(self.default)) == INCLUDE)

    def admit(self, inv: DataFrame) -> DataFrame:
        """The rows that pass."""
        kept = inv if self.only is None else self._listed(inv)
        if len(self.rules) > EXPRESSIONS:
            return self._decided(kept.filter(self.limits_admit(inv))).filter(self._by_table(inv)).select(*inv.columns)
        return kept.filter(self.admitted(inv)) if self.restricting else kept

    def flag(self, inv: DataFrame, name: str = "admitted") -> DataFrame:
        """Every row with whether `admit` would keep it."""
        if len(self.rules) > EXPRESSIONS:
            marked = self._decided(inv if self.only is None else self._mark_listed(inv))
            listed = F.lit(True) if self.only is None else F.col("_listed")
            return marked.withColumn(name, listed & self._by_table(inv)).select(*inv.columns, name)
        if self.only is None:
            return inv.withColumn(name, self.admitted(inv))
        return self._mark_listed(inv).withColumn(name, F.col("_listed") & self.admitted(inv)).drop("_listed")

    def admits_enumerated(self, inv: DataFrame) -> DataFrame:
        """`admit`, and every directory above a row may be entered: no directory-only exclude matches one.

        An earlier include does not rescue it. With a path list the walk follows the list instead.
        """
        pruned = self.pruned_above(F.col("path"))
        kept = self.admit(inv)
        return kept if pruned is None else kept.filter(~pruned)

    def pruned_above(self, path: Column) -> Column | None:
        closing = [r for r in self.rules if r.action == EXCLUDE and r.directories_only]
        if self.only is not None or not closing:
            return None
        if any(r.matches_root() for r in closing):
            return F.lit(True)
        return path.rlike("(?s)" + "|".join(f"(?:{r.above_regex()})" for r in closing))

    def explain(self, inv: DataFrame) -> DataFrame:
        """Every row with `action`, `reason` and, when a rule decided, its 1-based `position`."""
        if not self.restricting:
            return inv.select("*", *self._verdict(F.lit("unfiltered"), F.lit(None).cast("long"), F.lit(INCLUDE)))
        source = inv if self.only is None else self._mark_listed(inv)
        limits = self._limit_reasons(inv)
        if self.only is not None:
            limits.insert(0, (~F.col("_listed"), "not-listed"))
        # One number says what decided: a limit (below 0), a rule (from 1), or nothing (0).
        decided = F.when(F.lit(False), F.lit(0))
        for number, (broken, _) in enumerate(limits, start=1):
            decided = decided.when(broken, F.lit(-number))
        if len(self.rules) > EXPRESSIONS:
            source = self._decided(source)
            marked = source.withColumn("_d", F.coalesce(decided, F.col("_first._position"), F.lit(0)))
            acted = F.col("_first._action")
        else:
            for number, rule in enumerate(self.rules, start=1):
                decided = decided.when(rule.predicate(F.col("path"), self._is_dir(inv)), F.lit(number))
            marked = source.withColumn("_d", decided.otherwise(F.lit(0)))
            acted = _pick([r.action for r in self.rules], F.col("_d"))

        by_limit, by_rule = F.col("_d") < 0, F.col("_d") > 0
        reason = F.when(by_rule, F.lit("rule")).when(by_limit, _pick([r for _, r in limits], -F.col("_d")))
        action = F.when(by_limit, EXCLUDE).when(by_rule, acted)
        position = F.when(by_rule, F.col("_d").cast("long"))
        verdict = self._verdict(F.coalesce(reason, F.lit("unmatched")), position, F.coalesce(action, F.lit(self.default)))
        return marked.select(*inv.columns, *verdict)

    def _verdict(self, reason: Column, position: Column, action: Column) -> list[Column]:
        return [action.alias("action"), reason.alias("reason"), position.alias("position")]

    # -- path list -----------------------------------------------------------------------------------

    def _list_keys(self, with_dirs: bool) -> DataFrame:
        files = self.only.select("path").distinct()
        if not with_dirs:
            return files.select(F.col("path").alias("_path"))
        above = files.select(F.explode(F.concat(paths.ancestors("path"), F.array("path"))).alias("_path")).distinct()
        return files.select(F.col("path").alias("_path"), F.lit(False).alias("_dir")).unionByName(
            above.withColumn("_dir", F.lit(True))
        )

    def _on_list(self, inv: DataFrame, keys: DataFrame) -> Column:
        on = inv["path"] == keys["_path"]
        return on & (inv["is_dir"] == keys["_dir"]) if "is_dir" in inv.columns else on

    def _listed(self, inv: DataFrame) -> DataFrame:
        keys = self._list_keys("is_dir" in inv.columns)
        return inv.join(keys, self._on_list(inv, keys), "left_semi")

    def _mark_listed(self, inv: DataFrame) -> DataFrame:
        keys = self._list_keys("is_dir" in inv.columns)
        joined = inv.join(keys, self._on_list(inv, keys), "left")
        return joined.withColumn("_listed", F.col("_path").isNotNull()).select(*inv.columns, "_listed")


def _pick(values: list[str], number: Column) -> Column:
    """The value with a 1-based number, NULL outside the list."""
    if not values:
        return F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(v) for v in values]), number - 1)


def _tests(rules: list[Rule], path: Column, is_dir: Column | bool) -> list[Column]:
    """Tests of neighbouring rules with one action, by one plan at any number: a rule that names some text is a
    test of its own, whose part about that text can reach the scan; rules of wildcards alone are alternatives of
    few regular expressions."""
    out = []
    for directories_only in (False, True):
        if directories_only and is_dir is False:
            continue
        mine = [rule for rule in rules if rule.directories_only == directories_only]
        apart = [rule for rule in mine if rule.matches_everything() or globs.literals(rule.pieces)]
        out += [rule.predicate(path, is_dir) for rule in apart]
        shapes = [rule.regex() for rule in mine if rule not in apart]
        for start in range(0, len(shapes), RULES_PER_REGEX):
            test = path.rlike("(?s)" + "|".join(f"(?:{r})" for r in shapes[start : start + RULES_PER_REGEX]))
            out.append(is_dir & test if directories_only and is_dir is not True else test)
    return out or [F.lit(False)]


def _any(tests: list[Column]) -> Column:
    """Disjunction as a balanced tree, so that thousands of tests do not nest thousands deep."""
    if len(tests) == 1:
        return tests[0]
    middle = len(tests) // 2
    return _any(tests[:middle]) | _any(tests[middle:])


def under(inv: DataFrame, prefix: str) -> DataFrame:
    """Rows at or below a target; the prefix test reaches the scan."""
    return inv.filter(paths.is_under(prefix, "path"))
