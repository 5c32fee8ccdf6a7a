"""Personal data: fixed patterns, wider candidates, boosted trees that choose among them, redaction."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
# At most about so many documents fit the trees: those whose key has a small enough hash.
FITTED = 20_000

# The base patterns. Possessive repeats and the guards before them find the same matches as the
# plain patterns (what they skip cannot match) in linear time and without recursion on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What each base pattern cannot do without: texts that lack it skip the search.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# High-recall generators; what they find may overlap the base spans and each other.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]++(?:\.[0-9]++){2,4}+|[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){3,7}+)",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20./-]?[0-9]{2,6}+){2,6}+",
    "phone": r"(?<![0-9])[(]?[0-9]{2,4}+[)]?(?:[\x20./-][(]?[0-9]{2,4}+[)]?){1,5}+",
}
WIDE_NEEDED = {"email": r"@|(?:at|AT)[\])]", "ip": r"[0-9A-Fa-f][.:]+[0-9A-Fa-f]", "card": r"[0-9]{3}", "phone": r"[0-9]{2}"}
HINTS = r"(?i)(?:mail|contact|write to|\bip\b|host|server|addr|card|visa|credit|pay|tel|phone|call|fax|mobile|cell)\W*\w{0,8}\W*$"
WHOLE_IPV6 = r"::|\A(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\z"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Texts are cut up by so many code points to look places up: a string is walked from its start to reach a place.
PAGE = 1024


def _once(value: Column, work: Callable[[Column], Column]) -> Column:
    """`work(value)`, with the value worked out once, however often lambdas in the work use it."""
    return F.get(F.transform(F.array(value), work), F.lit(0))


def _pages(text: Column) -> Column:
    """The text in strings of PAGE code points, the last of them shorter."""
    return F.when(F.length(text) > PAGE, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))).otherwise(F.array(text))


def _part(pages: Column, start: Column, end: Column) -> Column:
    """What stands from `start` to before `end`; only the pages there are touched."""
    first = F.floor(start / PAGE).cast("int")
    held = F.array_join(F.slice(pages, first + 1, F.floor(end / PAGE).cast("int") - first + 1), "")
    return F.substring(held, start - first * PAGE + 1, end - start)


def _in_pieces(items: Column, work: Callable[[Column, Column], Column]) -> Column:
    """The results of `work(earlier items, items of a piece)` in a row, for pieces of about as many items as there are pieces.

    An array that grows item by item is copied at each step: within a piece that stays short, however many items there are.
    """

    def pieces(all_items: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_items))).cast("int"), F.lit(1))
        last = F.greatest(F.ceil(F.size(all_items) / size).cast("int") - 1, F.lit(0))
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: work(F.slice(all_items, F.lit(1), k * size), F.slice(all_items, k * size + 1, size))))

    return _once(items, pieces)


def _found(text: Column, pattern: str, needed: str) -> Column:
    """Matches with their places: array of (start, end, match), in code points, end exclusive.

    What lies between the matches comes from splitting at them; the running total of the lengths of both gives
    the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    pairs = F.arrays_zip(between.alias("gap"), matches.alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        # The last gap has no match after it.
        ended = pair["match"].isNull()
        return F.struct(F.when(ended, start).otherwise(end).alias("at"), F.when(ended, state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"))

    def placed(earlier: Column, piece: Column) -> Column:
        at = F.aggregate(earlier, F.lit(0), lambda total, pair: total + pair["gap"] + F.length(pair["match"]))
        return F.aggregate(piece, F.struct(at.alias("at"), none.alias("out")), add, lambda state: state["out"])

    return F.when(text.rlike(needed), _in_pieces(pairs, placed)).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (kind, start, end) of the base patterns that pass their tests, kinds in order."""

    def of(kind: str) -> Column:
        kept = F.filter(_found(text, BASE[kind], NEEDED[kind]), lambda m: _valid(kind, m["match"]))
        return F.transform(kept, lambda m: _span(kind, m))

    return F.concat(*[of(kind) for kind in KINDS])


def _span(kind: str, m: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def is_kind(kind: str) -> Callable[[Column], Column]:
    """A test of one argument: Spark hands the place of an item to a second one, even where that has a default."""
    return lambda s: s["kind"] == KINDS.index(kind)


# Features: small whole numbers, so that equal candidates can be counted instead of listed.
FEATURES = ("kind", "digits", "groups", "mixed", "mark", "before", "after", "hint", "luhn")


def _candidates(text: Column) -> Column:
    """array of wider candidates: (kind, start, end, features)."""

    def of(kind: str, pages: Column) -> Column:
        def described(m: Column) -> Column:
            match, digits = m["match"], _digits(m["match"])
            lead = _part(pages, F.greatest(m["start"] - 24, F.lit(0)), m["start"])
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                F.least(F.length(digits), F.lit(20)).alias("digits"),
                F.least(F.size(F.split(match, r"[^A-Za-z0-9]+", -1)), F.lit(9)).alias("groups"),
                F.size(F.array_distinct(F.split(F.regexp_replace(match, r"[A-Za-z0-9]", ""), ""))).cast("int").alias("mixed"),
                F.when(match.rlike(WHOLE_IPV6), 4).when(match.rlike(r"@[^@]+\."), 3).when(match.contains("@"), 2).when(match.rlike(r"[\[(]"), 1).otherwise(0).alias("mark"),
                _near(_part(pages, F.greatest(m["start"] - 1, F.lit(0)), m["start"])).alias("before"),
                _near(_part(pages, m["end"], m["end"] + 1)).alias("after"),
                lead.rlike(HINTS).cast("int").alias("hint"),
                _luhn(digits).cast("int").alias("luhn"),
            )

        return F.transform(_found(text, WIDE[kind], WIDE_NEEDED[kind]), described)

    return _once(_pages(text), lambda pages: F.concat(*[of(kind, pages) for kind in KINDS]))


def _likely(c: Column) -> Column:
    """Whether a wider candidate shows what it is by more than its format: a spelt-out sign, a check digit or the word before it."""
    spelt = (c["kind"] == 0) & (c["mark"] == 1) & (c["groups"] >= 5)
    address = (c["kind"] == 1) & (c["mark"] == 4)
    card = (c["kind"] == 2) & (c["luhn"] == 1) & (c["hint"] == 1) & c["digits"].between(13, 19)
    phone = (c["kind"] == 3) & (c["hint"] == 1) & c["digits"].between(10, 15)
    return spelt | address | card | phone


def _near(c: Column) -> Column:
    """What the neighbouring character is: none or space 0, + 1, letter 2, digit 3, = or quote 4, other 5."""
    return (
        F.when((c == "") | c.rlike(r"\s"), 0).when(c == "+", 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).when(c.rlike("[='\"]"), 4).otherwise(5)
    )


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _reaches(spans: Column) -> Column:
    """Spans in order of their start, in about as many pieces as a piece has spans: array of (start, end, spans), with the reach of each piece."""
    fields = ("start", "end", "kind", "score")
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in fields])))

    def reach(_: Column, piece: Column) -> Column:
        start = F.coalesce(F.get(piece, F.lit(0))["start"], F.lit(0))
        end = F.coalesce(F.array_max(F.transform(piece, lambda s: s["end"])), F.lit(0))
        return F.array(F.struct(start.alias("start"), end.alias("end"), piece.alias("spans")))

    return _in_pieces(ordered, reach)


def _met(reaches: Column, c: Column, test: Callable[[Column], Column] | None = None) -> Column:
    """Whether a span that overlaps `c` passes the test: of the pieces, only those that reach `c` are opened."""
    return F.exists(reaches, lambda r: _overlap(r, c) & F.exists(r["spans"], lambda s: _overlap(s, c) & (test(s) if test else F.lit(True))))


def _unscored(spans: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("score", F.lit(0.0)))


@dataclass(frozen=True)
class Split:
    feature: str
    value: int
    yes: Split | float = 0.0  # where feature >= value
    no: Split | float = 0.0


@dataclass
class Model:
    """Boosted trees, and for each kind the least score at which a candidate is personal data (None: never)."""

    trees: list[Split] = field(default_factory=list)
    prior: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    least: dict[str, float | None] = field(default_factory=dict)

    def score(self, candidate: Column) -> Column:
        """The calibrated probability as a nested conditional expression."""

        def walk(node: Split | float) -> Column:
            if not isinstance(node, Split):
                return F.lit(float(node))
            return F.when(candidate[node.feature] >= node.value, walk(node.yes)).otherwise(walk(node.no))

        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + walk(tree)
        a, b = self.scale
        return 1 / (1 + F.exp(-(F.lit(a) * total + F.lit(b))))

    def raw(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        total = np.full(len(cells["kind"]), self.prior)
        for tree in self.trees:
            total += _leaf(tree, cells)
        return total


def _leaf(node: Split | float, cells: dict[str, np.ndarray]) -> np.ndarray:
    if not isinstance(node, Split):
        return np.full(len(cells["kind"]), node)
    return np.where(cells[node.feature] >= node.value, _leaf(node.yes, cells), _leaf(node.no, cells))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = FITTED, rounds: int = 30, depth: int = 3, precision: float = 0.9) -> Model:
    """Fit on about `bound` documents (all, if there are fewer), picked by the hash of their keys.

    A candidate that overlaps a base span of its kind counts as personal data, and so does one that overlaps none
    but shows what it is by a spelt-out sign, a check digit or the word before it: the trees learn what places look like
    beyond the fixed patterns. Thresholds are set on candidates that overlap no base span, as only those can be added. Equal
    candidates are counted by Spark, and only the counts come to the driver; the features have few values, so
    their number is bounded, whatever the corpus. Half of the documents set the calibration and thresholds.
    """
    total = docs.count()
    share = min(1.0, bound / total) if total else 1.0
    picked = docs.filter(F.pmod(F.xxhash64(docs[key]), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    whole = picked.select(text_of(picked, text).alias("text"), F.pmod(F.xxhash64(F.lit(1), picked[key]), F.lit(2)).cast("int").alias("half"))

    def labelled(base: Column) -> Column:
        def label(c: Column) -> Column:
            grown, free = _met(base, c, lambda b: b["kind"] == c["kind"]), ~_met(base, c)
            return F.struct((grown | (free & _likely(c))).cast("int").alias("real"), free.cast("int").alias("free"), *[c[f].alias(f) for f in FEATURES])

        return F.transform(_candidates(F.col("text")), label)

    # Labels are set inside the row: exploded rows would each carry all base spans of their text.
    cells = whole.select("half", F.inline(_once(_reaches(_unscored(base_spans(F.col("text")))), labelled)))
    rows = cells.groupBy("half", "real", "free", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    return boosted([r.asDict() for r in rows], rounds, depth, precision)


def boosted(rows: list[dict], rounds: int = 30, depth: int = 3, precision: float = 0.9, rate: float = 0.3) -> Model:
    """Logistic boosting over counted cells; the other half calibrates (Platt) and sets each kind's threshold.

    Rows with `free` 0 overlap a base span: they teach, but set no threshold.
    """
    rows = sorted(({"free": 1} | r for r in rows), key=lambda r: tuple(r[f] for f in ("half", "real", "free", *FEATURES)))
    cells = {f: np.array([r[f] for r in rows], int) for f in ("half", "real", "free", "n", *FEATURES)}
    train = cells["half"] == 0
    model = Model(least=dict.fromkeys(KINDS))
    y, n = cells["real"].astype(float), cells["n"].astype(float)
    if not len(rows) or not 0 < (y * n)[train].sum() < n[train].sum() or not 0 < (y * n)[~train].sum() < n[~train].sum():
        return model  # nothing to tell apart: base spans only
    model.prior = float(np.log((y * n)[train].sum() / ((1 - y) * n)[train].sum()))
    total = np.full(len(rows), model.prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _tree(cells, train, n * (y - p), n * p * (1 - p), depth, rate)
        model.trees.append(tree)
        total += _leaf(tree, cells)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps for the calibration on the half held back
        z = total[~train]
        p = 1 / (1 + np.exp(-(a * z + b)))
        g, h = n[~train] * (y[~train] - p), n[~train] * p * (1 - p)
        hessian = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, np.array([(g * z).sum(), g.sum()]) - 1e-3 * np.array([a - 1, b]))
        a, b = a + float(np.clip(move[0], -0.5, 0.5)), b + float(np.clip(move[1], -0.5, 0.5))
    model.scale = (a, b)
    chance = 1 / (1 + np.exp(-(a * total + b)))
    for k, kind in enumerate(KINDS):
        mine = ~train & (cells["kind"] == k) & (cells["free"] == 1)
        for level in np.unique(chance[mine]):
            over = mine & (chance >= level)
            if level >= 0.5 and (y * n)[over].sum() >= max(5, precision * n[over].sum()):
                model.least[kind] = float(level) - 1e-9
                break
    return model


def _tree(cells: dict[str, np.ndarray], among: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Split | float:
    def value(rows: np.ndarray) -> float:
        return g[rows].sum() ** 2 / (h[rows].sum() + 1.0)

    if depth:
        best, most = None, 1e-6
        for feature in FEATURES:
            for level in np.unique(cells[feature][among])[1:]:
                yes = among & (cells[feature] >= level)
                gain = value(yes) + value(among & ~yes) - value(among)
                if gain > most:
                    best, most = (feature, int(level), yes), gain
        if best:
            feature, level, yes = best
            return Split(feature, level, _tree(cells, yes, g, h, depth - 1, rate), _tree(cells, among & ~yes, g, h, depth - 1, rate))
    return float(rate * g[among].sum() / (h[among].sum() + 1.0))


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `text` (null read as empty), `base` and `spans`: arrays of (kind, start, end), base spans always among all.

    A wider candidate is added if its score reaches its kind's threshold, it overlaps no base span, and no
    candidate that reaches its own and overlaps it scores higher (ties: the earlier, then the longer, then the
    kind listed first). Expressions of one row only: no shuffle, no Python. Repeated rows give repeated results.
    """
    whole = docs.select(docs[key].alias(key), text_of(docs, text).alias("text"))
    step = whole.select(key, "text", base_spans(F.col("text")).alias("base"))
    if not any(level is not None for level in model.least.values()):
        return step.withColumn("spans", F.col("base"))
    free = _once(_reaches(_unscored(F.col("base"))), lambda base: F.filter(_candidates(F.col("text")), lambda c: ~_met(base, c)))
    levels = F.array(*[F.lit(2.0 if model.least.get(k) is None else model.least[k]) for k in KINDS])

    def scored(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), model.score(c).alias("score"))

    def rank(c: Column) -> Column:
        return F.struct(-c["score"], c["start"], -c["end"], c["kind"])

    step = step.withColumn("_wide", F.filter(F.transform(free, scored), lambda c: c["score"] >= F.get(levels, c["kind"])))
    best = _once(_reaches(F.col("_wide")), lambda wide: F.filter("_wide", lambda c: ~_met(wide, c, lambda d: rank(d) < rank(c))))
    more = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return step.select(key, "text", "base", F.concat("base", more).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first names the union."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    none = F.array().cast("array<string>")

    def written(pages: Column) -> Column:
        def add(state: Column, s: Column) -> Column:
            fresh = s["start"] >= state["at"]
            piece = _part(pages, state["at"], s["start"])
            out = F.when(fresh, F.concat(state["out"], F.array(piece, F.get(names, s["kind"])))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

        def replaced(earlier: Column, piece: Column) -> Column:
            at = F.aggregate(earlier, F.lit(0), lambda most, s: F.greatest(most, s["end"]))
            return F.aggregate(piece, F.struct(at.alias("at"), none.alias("out")), add, lambda state: state["out"])

        rest = F.coalesce(F.array_max(F.transform(found, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(_in_pieces(ordered, replaced), ""), F.substring(text, rest + 1, F.length(text)))

    return _once(_pages(text), written)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", bound: int = FITTED) -> DataFrame:
    """The rows of `docs` with every span replaced in `text`, and `length`, if there is such a column, counted again.

    A null text stays null. All other columns stay as they are.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    found = spans(docs.select(row.alias("row"), docs[text].alias("text")), fit(docs, key, text, bound), "row", "text")
    whole = F.when(F.col("row")[text].isNotNull(), F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    out = found.select("row", whole.alias("new"))
    columns = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text:
            value = F.col("new")
        elif c == length:
            value = F.when(F.col("new").isNull(), value).otherwise(F.length("new").cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return out.select(*columns)
