"""The text operators against brute force on small tables with nulls, repeats, ties, long texts and clashing columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from objcat.llm import components, decontamination, licenses, lines, mixing, near, pages, pii, queries, rules, similar, simhash, tokens, urls
from objcat.session import scratch_folder

EXTRA = "id string, row string, copy string, place string, kind string, n_words string, kept string, spans string, fingerprint string, base string, _text string"


def documents(spark, rows):
    """doc_id, text, source, n_chars and columns named like the ones that operators make."""
    extra = [c.split()[0] for c in EXTRA.split(", ")]
    full = [(i, t, s, None if t is None else len(t), *["x"] * len(extra)) for i, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, source string, n_chars long, {EXTRA}")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(5)
    prose = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(draw.randint(1, 90))) for _ in range(30)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(prose)]
    rows += [(30, None, "s0"), (31, "", None), (32, " \n\t ", None), (33, prose[3], "s1"), (33, prose[3], "s1"), (None, prose[4], "s2"), (34, "long word " * 20_000, "s2")]
    return documents(spark, rows)


# 1


def test_copies_follow_the_poisson_distribution(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").alias("source"))
    weights = {"a": 1.0, "b": 0.0}
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, weights, rest=1.0).collect()}
    assert rates == pytest.approx({"a": 2.0, "b": 0.0, None: 1.0})
    drawn = mixing.copies(docs, mixing.rates(docs, weights, rest=1.0), seed=3).select("source", "_copies").collect()
    for source, mean in rates.items():
        numbers = [r["_copies"] for r in drawn if r["source"] == source]
        assert np.mean(numbers) == pytest.approx(mean, abs=0.15) and np.var(numbers) == pytest.approx(mean, abs=0.3)


def test_large_rates_and_determinism(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("a").alias("source"))
    once = mixing.mix(docs, {"a": 1.0}, total=60 * 3 * 100.0, seed=1)
    again = mixing.mix(docs.repartition(7), {"a": 1.0}, total=60 * 3 * 100.0, seed=1)
    counts = collections.Counter(r["doc_id"] for r in once.collect())
    assert counts == collections.Counter(r["doc_id"] for r in again.collect())
    assert np.mean(list(counts.values())) == pytest.approx(100, abs=5)


def test_mixture_of_odd_rows(odd):
    mixed = mixing.mix(odd, {"s0": 2.0}, rest=1.0)
    assert set(mixed.columns) == set(odd.columns)  # copy and place take the place of the columns of that name
    rows = mixed.collect()
    assert rows and all(isinstance(r["copy"], int) and len(r["place"]) == 32 for r in rows)
    assert mixing.mix(odd.limit(0), {"s0": 1.0}, rest=1.0).count() == 0


# 2


def test_alignment_is_in_order_and_whole():
    draw = random.Random(2)
    for _ in range(200):
        notice = [b"%d" % draw.randint(0, 9) for _ in range(draw.randint(1, 15))]
        text = [w for w in notice if draw.random() < 0.8] + [b"%d" % draw.randint(0, 9) for _ in range(5)]
        pairs = licenses.aligned(text, notice)
        assert all(text[i] == notice[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    assert len(licenses.aligned(notice, notice)) == len(notice)


def test_license_places(spark):
    mit = licenses.NOTICES["MIT-permission"]
    changed = mit.replace("free of charge", "gratis").replace("publish", "print").upper()
    text = f"é prose before. {mit} and between {changed} and the rest, of the words, in the License of nothing."
    rows = [(1, text, "a"), (2, None, "a"), (3, "", "a"), (4, "the license is free of the software " * 300, "a"), (5, text, "a"), (5, text, "a")]
    found = licenses.scan(documents(spark, rows)).collect()
    places = sorted((r["start"], r["end"]) for r in found if r["doc_id"] == 1 and r["license"] == "MIT-permission")
    assert len(places) == 2 and text[slice(*places[0])] + "." == mit
    assert text[places[1][0] :].startswith("PERMISSION") and places[1][0] > places[0][1]
    assert {r["doc_id"] for r in found} == {1, 5} and sum(r["doc_id"] == 5 for r in found) == 2 * sum(r["doc_id"] == 1 for r in found)
    assert licenses.scan(documents(spark, [])).count() == 0


# 3


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_by_brute_force(spark):
    draw = random.Random(3)
    made = ["".join(draw.choice("a1+@.- 9(é𝄞") for _ in range(draw.randint(0, 60))) for _ in range(300)]
    made += ["a@b.c%x@y.z", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "4111 1111-1111 1111", "+1 (234) 555-6789 x", "0" * 16, "1" * 50_000, "a" * 50_000, "9 " * 50_000, "🙂 q@r.st"]
    made += [f"{draw.randint(0, 300)}.{draw.randint(0, 300)}.0{draw.randint(0, 300)}.{draw.randint(0, 300)}" for _ in range(50)]
    rows = [(i, t, "a") for i, t in enumerate(made)] + [(len(made), None, "a")]
    found = pii.spans(documents(spark, rows), pii.Model()).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()
    for r in found:
        assert r["base"] == r["spans"] == base_by_hand((made + [""])[r["doc_id"]])


def test_addresses_with_parts_of_zero(spark):
    made = ["0.0.0.0", "10.0.0.1", "at 8.8.8.0.", "127.0.0.1 00.000.0.0255", "192.168.0.5", "0.0.0.256", "00.0.0.0300", "1.0.0", "0" * 4_000 + ".0.0.0"]
    found = pii.spans(documents(spark, [(i, t, "a") for i, t in enumerate(made)]), pii.Model()).select("doc_id", pii.listed(F.col("base")).alias("base")).collect()
    assert all(r["base"] == base_by_hand(made[r["doc_id"]]) for r in found)
    assert sum(r["base"].count("ip:") for r in found) == 7


def test_counts_of_the_query_are_of_base_spans(spark, tmp_path):
    card, phone = "4111 1111-1111 1111", "+1 (234) 555-6789"
    made = ["a@b.cd x@y.zz 1.2.3.4 " + card, phone, f"{card} {phone} {phone}", "10.0.0.1", "none", ""]
    # Enough spelt-out addresses that the trees add them: they are listed, not counted.
    made += [f"see name{i} [at] host{i % 7} [dot] org soon" if i % 2 else f"see name{i}@host.org or {i} {i + 7} soon" for i in range(400)]
    documents(spark, [*((i, t, "a") for i, t in enumerate(made)), (len(made), None, "a")]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries._pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate([*made, ""]):
        base = base_by_hand(text)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [base.count(f"{k}:") for k in pii.KINDS]
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert rows[7]["spans"] == "email:4:30" and rows[7]["n_email"] == 0


def test_trees_add_what_looks_alike(spark):
    def row(half, real, n, **values):
        return dict.fromkeys(pii.FEATURES, 0) | {"half": half, "real": real, "n": n} | values

    cells = [row(h, 1, 50, kind=3, digits=10, groups=3, hint=1) for h in (0, 1)] + [row(h, 0, 50, kind=3, digits=6, groups=2) for h in (0, 1)]
    model = pii.boosted(cells)
    assert model.least["phone"] is not None and model.least["email"] is None
    text = "call 555 123 4567 or a@b.cd; item 55 1234"
    docs = documents(spark, [(1, text, "a"), (2, None, "a")])
    got = {r["doc_id"]: r["s"] for r in pii.spans(docs, model).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert got == {1: "phone:5:17,email:21:27", 2: ""}
    assert pii.boosted([]).least == dict.fromkeys(pii.KINDS)


def test_trees_add_planted_places_beyond_the_patterns(spark):
    draw = random.Random(6)
    number = lambda n: "".join(draw.choice("123456789") for _ in range(n))
    planted, rows = {}, []
    for i in range(400):
        kind, what = [
            ("email", f"name{number(2)} [at] host{number(1)} [dot] org"),
            ("ip", ":".join(f"{draw.randrange(16**4):04x}" for _ in range(8))),
            ("phone", f"{number(3)} {number(3)} {number(4)}"),
            ("email", f"name{number(2)}@host.org"),
            (None, f"{number(3)} {number(2)}"),
        ][i % 5]
        before = {"phone": "call ", "ip": "from "}.get(kind, "see ")
        planted[i] = f"{kind}:{len(before)}:{len(before) + len(what)}" if kind else ""
        rows.append((i, f"{before}{what} soon", "a"))
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["s"] for r in pii.spans(docs, pii.fit(docs)).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert got == planted


def test_many_places_in_one_text_are_those_of_its_parts(spark):
    draw = random.Random(9)
    number = lambda n: "".join(draw.choice("123456789") for _ in range(n))
    makes = [
        lambda: f"𝄞 name{number(2)} [at] host{number(1)} [dot] org",
        lambda: f"name{number(2)}@host.org or 10.0.{number(2)}.0 é",
        lambda: f"call {number(3)} {number(3)} {number(4)}",
        lambda: f"see {number(3)} {number(2)}",
        lambda: "4111 1111 1111 1111 +1 (234) 555-6789",
    ]
    parts = [draw.choice(makes)() + " und" * draw.randint(8, 40) + " " for _ in range(4_000)]
    began = time.perf_counter()
    parted = documents(spark, [(i, p, "a") for i, p in enumerate(parts)])
    model = pii.fit(parted)
    assert model.least["email"] is not None and model.least["phone"] is not None
    found = lambda docs: pii.spans(docs, model).select("doc_id", "text", "spans")
    cut = found(parted).select("doc_id", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("new")).orderBy("doc_id").collect()
    whole = found(documents(spark, [(1, "".join(parts), "a")])).select("spans", pii.redacted(F.col("text"), F.col("spans")).alias("new")).collect()[0]
    at, want = 0, []
    for part, r in zip(parts, cut):
        want += [(s["start"] + at, s["end"] + at, s["kind"]) for s in r["spans"]]
        at += len(part)
    assert len(want) > 4_000 and sorted((s["start"], s["end"], s["kind"]) for s in whole["spans"]) == sorted(want)
    assert whole["new"] == "".join(r["new"] for r in cut)
    assert time.perf_counter() - began < 120


def test_redaction_keeps_everything_else(spark, odd):
    docs = documents(spark, [(1, "é a@b.cd and no. 4111 1111 1111 1111", "a"), (2, None, "a"), (3, "plain", None)])
    rows = {r["doc_id"]: r for r in pii.clean(docs).collect()}
    assert rows[1]["text"].startswith("é [EMAIL] and no. [CARD]") and "4111" not in rows[1]["text"] and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] is None and rows[3]["text"] == "plain" and rows[3]["kept"] == "x"
    assert pii.clean(odd).columns == odd.columns and pii.clean(odd.limit(0)).count() == 0


# 4


def test_tiles_in_any_order(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    turned = " ".join(w[6:]) + " and then, " + " ".join(w[:6]).upper()
    rows = [(1, f"x y {turned} z", "a"), (2, " ".join(w[:6]) + " other words", "a"), (3, None, "a"), (None, item, "a"), (4, "word " * 50_000 + item, "a"), (4, "word " * 50_000 + item, "a"), (5, "one five two", "a")]
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "one"), (4, "")], "item_id long, text string")
    docs = documents(spark, rows)
    found = decontamination.contaminated(docs, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["n_tiled"], r["n_tiles"]) for r in found) == [(0, 1, 12, 1), (1, 1, 12, 2), (4, 1, 12, 1), (4, 1, 12, 1)]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()) == [2, 3, 5]
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0 and decontamination.clean(docs, benchmark.limit(0)).count() == len(rows)
    assert [len(b) for b in decontamination.blocks(benchmark, "item_id", "text", limit=1)] == [1, 1]


def tiled_words(text, item, length=5):
    """Greedy string tiling by trying every pair of places: the number of words of `item` that are marked."""
    used, marked = [False] * len(text), [False] * len(item)
    while True:
        runs = []
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not used[i + n] and not marked[j + n]:
                    n += 1
                runs.append((-n, i, j))
        longest = -min(runs, default=(0,))[0]
        if longest < length:
            return sum(marked)
        for _, i, j in sorted(r for r in runs if r[0] == -longest):
            if not any(used[i : i + longest]) and not any(marked[j : j + longest]):
                used[i : i + longest] = marked[j : j + longest] = [True] * longest


def test_tiling_by_brute_force_in_one_block_or_many(spark, monkeypatch):
    draw = random.Random(6)
    items = [[draw.choice("abc") * draw.randint(1, 2) for _ in range(draw.choice((0, 3, 7, 15)))] for _ in range(12)]
    texts = []
    for n in range(40):
        parts = [draw.choice(items) for _ in range(3)]
        parts = [p[draw.randint(0, 2) :] for p in parts] + [["z"], [draw.choice("abc") for _ in range(12)]]
        draw.shuffle(parts)
        texts.append([w for p in parts for w in p])
    want = set()
    for n, text in enumerate(texts):
        for m, item in enumerate(items):
            tiled = tiled_words(text, item)
            if tiled and tiled >= 0.6 * len(item):
                want.add((n, m, tiled))
    docs = documents(spark, [(n, " ".join(t), "a") for n, t in enumerate(texts)])
    benchmark = spark.createDataFrame([(m, " ".join(i)) for m, i in enumerate(items)], "item_id long, text string")
    assert want and len({n for n, _, _ in want}) < len(texts)
    for limit in (8_000_000, 20):
        blocks = decontamination.blocks
        monkeypatch.setattr(decontamination, "blocks", lambda b, i, t, limit=limit: blocks(b, i, t, limit))
        found = decontamination.contaminated(docs, benchmark)
        assert {(r["doc_id"], r["item_id"], r["n_tiled"]) for r in found.collect()} == want
        kept = {r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()}
        assert kept == set(range(len(texts))) - {n for n, _, _ in want}
        monkeypatch.undo()


def test_tiling_of_repetition():
    for text, item, want in (
        ("a " * 200_000, "a " * 100, (100, 100, 1)),
        ("a b a b a b a c " * 5_000, "a b " * 500 + "c", (1001, 875, 125)),
        ("a " * 7 + "x " + "a " * 6, "a " * 20, (20, 13, 2)),
    ):
        began = time.perf_counter()
        assert list(decontamination.Block([(1, item)], 5).matches(text.encode(), 0.6)) == [(1, *want)]
        assert time.perf_counter() - began < 10


# 5


@pytest.mark.parametrize("pattern,run", [(lines.SENTENCES, lines.RUN), (lines.SENTENCES, 1), (lines.LINES, 12)])
def test_units_by_brute_force(spark, pattern, run):
    draw = random.Random(4)
    pool = [" ".join(draw.choice("abcdefgh") for _ in range(n)) + draw.choice([". ", "!\n", "?! \n\n", "\n", "。", " "]) for n in (1, 2, 5, 8, 12, 17, 31)] + ["漢字" * 20 + "。", "ไทย" * 11 + "\n"]
    rows = [(i, "".join(draw.choice([p, p.upper(), f" {p}"]) for p in draw.choices(pool, k=draw.randint(0, 9))) + draw.choice(["", f"end {i}"]), "a") for i in range(60)]
    rows += [(60, None, "a"), (61, "", "a"), (62, "\n \n", "a"), (59, rows[59][1], "a"), (None, pool[6], "a"), (63, ("x " * 20 + ".\n") * 3000, "a"), (58, pool[6] * 2, "a")]
    got = collections.defaultdict(set)
    for r in lines.dedupe(documents(spark, rows), pattern, run).collect():
        got[r["doc_id"]].add((r["text"], r["n_removed"], tuple(tuple(s) for s in r["removed"])))
    marks = set(".!?…。！？｡\n") if pattern == lines.SENTENCES else set("\n")
    spaces = set(" \t\n\v\f\r") if pattern == lines.SENTENCES else set()

    def pieces(text):
        out, begin, at = [], 0, 0
        while at < len(text):
            at += 1
            if text[at - 1] in marks:
                while spaces and at < len(text) and text[at] in marks | spaces:
                    at += 1
                out.append((begin, at))
                begin = at
        return out + [(begin, at)] * (begin < at)

    seen, expected = set(), collections.defaultdict(set)
    unique = {(i, t or "") for i, t, _ in rows}
    hashes = {(r["doc_id"], r["t"]): r["h"] for r in documents(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for i, text in sorted(unique, key=lambda p: (p[0] is not None, p[0] or 0, hashes[p])):
        again, spans, count = [], [], 0
        for a, b in pieces(text):
            plain = " ".join(text[a:b].lower().split())
            again.append((a, b, bool(plain) and plain in seen, len(re.findall("[\u0e00-\u9fff]|[^\\s\u0e00-\u9fff]+", plain))))
            if plain:
                seen.add(plain)
        for repeat, group in itertools.groupby(again, key=lambda u: u[2]):
            group = list(group)
            if repeat and sum(u[3] for u in group) >= run:
                spans.append((group[0][0], group[-1][1]))
                count += len(group)
        rest, at = "", 0
        for a, b in [*spans, (len(text), len(text))]:
            rest, at = rest + text[at:a], b
        expected[i].add((rest, count, tuple(spans)))
    assert got == expected and sum(len(s[2]) for some in expected.values() for s in some) > 20
    assert lines.dedupe(documents(spark, []), pattern, run).count() == 0


# 6


def test_blocks_reach_aliases(spark):
    def page(i, url, head=""):
        return (i, url, f"<html><head>{head}</head><body>x</body></html>", "x")

    rows = [
        page(1, "https://a.example.ORG/x", '<link href="//b.test/y?q=1&amp;r=2" rel="shortlink canonical">'),
        page(2, "http://b.test/y?q=1&r=2#top", "<meta http-equiv=Refresh content=\"0; URL='http://sub.other.NET/z'\">"),
        page(3, "http://other.test/", '<!-- <link rel=canonical href="http://bad.net/"> -->'),
        page(4, "https://www.example.net/en/1"),
        page(5, "https://example.net/de/1"),
        page(6, "https://q.org/fr/", '<link rel=canonical href="http://bad.net/">'),
        page(7, "https://q.org/de/", '<link rel="canonical" href="/de/2">'),
        page(8, "https://q.org/de/2", '<link rel="canonical" href="3">'),
        page(9, "https://q.org/de/3", '<link rel="canonical" href="http://q.org/fr/">'),
        page(10, None),
        page(11, "not a url"),
        page(12, "https://notexample.com/de/"),
        (13, "https://x.example.com/de/", None, "x"),
        page(5, "https://example.net/de/1"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    rules_ = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(frame, rules_).collect()}
    assert got == {
        1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("example.net/en/", "allow"), 5: ("net/", "block"), 6: ("org/fr/", "allow"),
        7: (None, "block"), 8: (None, "block"), 9: (None, "block"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"), 13: ("example.com/de/", "block"),
    }
    assert urls.judge(frame, rules_).count() == len(rows) and urls.judge(frame.limit(0), rules_).count() == 0


def test_components_by_brute_force(spark):
    draw = random.Random(6)
    edges = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)] + [(5, None), (7, 7)]
    parent = {n: n for e in edges for n in e if n is not None}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if b is not None and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {n for a, b in edges if b is not None and a != b for n in (a, b)}
    got = components.connected(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in got} == {n: root(n) for n in linked} and len(got) == len(linked)


# 7


def test_main_text():
    story = "".join(f"<p>Sentence {i} of the story &amp; more &#233;, with <a href=x>a link</a> in it and many words to read.\n  Next line.</p>" for i in range(5))
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
      <header><p>Site name and slogan</p></header><nav><a href=a>Home</a></nav><div class="cookie-notice">We use cookies, many of them.</div>
      <article><h1>Title</h1>{story}<form><p>Sign up</p></form><section id="comments"><p>First! I like this story very much.</p></section></article>
      <aside><p>Sidebar text</p></aside><div class=ad>Buy now</div><footer>&copy; us</footer></body></html>"""
    blocks = pages.main_text(page).split("\n")
    assert blocks[0] == "Title" and len(blocks) == 6
    assert blocks[1] == "Sentence 0 of the story & more é, with a link in it and many words to read. Next line."
    plain = f"<body><div class=menu><a href=a>a</a> <a href=b>b</a></div><div><div>{story}</div></div><div><a href=c>c</a></div>"
    assert len(pages.main_text(plain).split("\n")) == 5
    assert pages.main_text("<p>one<p>two <b>bold<p>three</b> x < y & z") == "one\ntwo bold\nthree x < y & z"
    for broken in ("", "<", "<<<>>>", "<p", "<!-- open", "</div></p>", "<script>never closed", "&#xZZ; &bogus;", "<div " + "a" * 99):
        pages.main_text(broken)
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert pages.main_text(deep) == "text"


def test_layout_names_do_not_take_the_text():
    story = "".join(f"<p>Sentence {i} of the story, with many words to read and no link in it at all.</p>" for i in range(5))
    for mark in ("class='container has-sidebar'", "class=no-sidebar", "class='main-content right-side'", "class='row hidden-xs'", "class=widget", "id=search"):
        page = f"<body><div class=menu><a href=a>a</a> <a href=b>b</a></div><div {mark}><div>{story}</div></div><div class=site-footer>All rights</div></body>"
        assert pages.main_text(page).count("Sentence") == 5 and "rights" not in pages.main_text(page), mark
    page = f"<article>{story}<section id='related-work'><p>Others did so too.</p></section><div id='share-prices'><p>They fell.</p></div><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p>"
    got = pages.main_text(page + "<div class='related-posts'><p>More</p></div><div class='share-buttons'><p>Post it</p></div><section id=comments>" + "<p>I have a lot to say about it.</p>" * 90 + "</section></article>")
    assert got.split("\n")[5:] == ["Others did so too.", "They fell.", "So x=2."]


def test_broken_pages_take_linear_time():
    draw = random.Random(8)
    broken = {
        "open blocks": "<div><p>" * 20_000,
        "open quotes": '<p class="x' * 50_000,
        "open apostrophes": "<a '" * 50_000,
        "no end": "<a" * 100_000,
        "quotes in any order": "".join(draw.choice("<a '\">") for _ in range(200_000)),
        "no end of title": "<title></title" * 20_000,
        "stray ends": "<b>" * 20_000 + "<i></x>" * 20_000,
    }
    for name, page in broken.items():
        began = time.perf_counter()
        pages.main_text(page)
        assert time.perf_counter() - began < 10, name


def test_reader_comments_by_structure():
    story = "".join(f"<p>Sentence {i} of the story, with many words to read and no link in it at all.</p>" for i in range(5))
    remarks = "".join(f"<div class=entry><span class=author>Reader {i}</span> <time>May {i}</time><p>Remark {i}: I have a lot to say about this and I will say it.</p></div>" for i in range(1, 31))
    bare = "".join(f"<div class=entry><p>Remark {i}: I have a lot to say about this and I will say it.</p></div>" for i in range(1, 31))
    for page in (
        f"<body><article>{story}</article><div class='reader-opinions'>{bare}</div>",
        f"<body><article>{story}</article><div class=x>{bare}</div>",
        f"<body><div class=text>{story}</div><div class='user-feedback'>{bare}</div>",
        f"<body><div class=text>{story}</div><div class=x>{remarks}</div>",
        f"<body><article>{story}<div class=x>{remarks}</div></article>",
    ):
        got = pages.main_text(page)
        assert got.count("Sentence") == 5 and "Remark" not in got, page[:80]
    # Entries with author and time that nothing comes before are the text, and so are rows without them inside an article.
    assert pages.main_text(f"<body><div class=x>{remarks}</div>").count("Remark") == 30
    assert pages.main_text(f"<body><article>{story}<div class=x>{bare}</div></article>").count("Remark") == 30


def test_pages_with_odd_rows(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a  b</p>", "x"), (2, None, None, "x"), (1, "u", "<p>a  b</p>", "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = pages.extract(frame).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert pages.extract(frame.limit(0)).count() == 0


# 8


def print_by_hand(text, shingle=4):
    w = text.encode().lower().split()
    parts = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def test_links_by_brute_force(spark):
    draw = random.Random(8)
    centres = [draw.getrandbits(64) for _ in range(40)]
    prints = set(centres) | {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(8):
            x = c
            for bit in draw.sample(range(64), draw.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    mask = (1 << 64) - 1
    for radius, blocks in ((4, 7), (2, 5)):
        expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= radius}
        found = [(r["a"], r["b"]) for r in simhash.links(frame, radius, blocks).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_groups_by_brute_force(spark, odd):
    found = simhash.groups(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    prints = {(r["doc_id"], r["text"]): print_by_hand(r["text"] or "") for r in rows}
    classes = {p: p for p in prints.values()}

    def root(p):
        while classes[p] != p:
            p = classes[p]
        return p

    for a in list(classes):
        for b in list(classes):
            if (a ^ b).bit_count() <= 4 and root(a) != root(b):
                classes[root(a)] = root(b)
    smallest = {}
    for (i, _), p in prints.items():
        smallest[root(p)] = min([x for x in (smallest.get(root(p)), i) if x is not None], default=None)
    expected = collections.Counter((r["doc_id"], f"{prints[r['doc_id'], r['text']]:016x}", smallest[root(prints[r["doc_id"], r["text"]])]) for r in rows)
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == expected
    kept = simhash.one_of_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and len(ids) == len(set(ids)) and {c for _, _, c in expected} <= set(ids) and None in ids
    assert simhash.groups(odd.limit(0)).count() == 0


def test_one_of_each_joins_groups_of_several_shingle_lengths(spark):
    both = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n in (5, 4):
        for r in simhash.groups(both, n).filter("component_id is not null").collect():
            a, b = root(r["doc_id"]), root(r["component_id"])
            parent[max(a, b)] = min(a, b)
    kept = [r["doc_id"] for r in simhash.one_of_each(both, (5, 4)).collect()]
    assert sorted(kept) == sorted({root(x) for x in parent})
    assert simhash.one_of_each(both.limit(0), (5, 4)).count() == 0


def test_similar_texts_by_brute_force(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    draw = random.Random(8)
    bases = [[draw.choice("abcdefghijkl") * draw.randint(1, 5) for _ in range(draw.randint(30, 200))] for _ in range(6)]
    made = []
    for i in range(90):
        w = list(bases[i % 6])
        for _ in range(draw.randint(0, 4)):
            w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
        made.append(" ".join(w[: draw.randint(len(w) * 3 // 4, len(w))]) + " one line that all of these documents have")
    made += ["", " ", "one", "ONE", "one two three four", "a b c d e", "a b c d e a b c d e", "a b c d e a b c d e a b c d e"]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in made]
    parent = list(range(len(made)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for b in range(len(made)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
                far += min((print_by_hand(made[a], n) ^ print_by_hand(made[b], n)).bit_count() for n in (4, 5)) > 4
    assert far > 20  # pairs that no fingerprint of the stage finds
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(made)] + [(None, made[0], "a"), (3, made[3], "a")])
    for most in (100_000, 0):  # the order of the shingles changes nothing
        monkeypatch.setattr(similar, "COMMON", most)
        got = {(r["doc_id"], r["component_id"]) for r in similar.groups(docs).collect()}
        assert got == {(i, root(i)) for i in range(len(made))}
    left = [r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect()]
    assert None in left and {i for i in left if i is not None} <= {root(i) for i in range(len(made))} and len(left) == len(set(left))
    assert similar.groups(docs.limit(0)).count() == 0


def test_near_texts_against_exact_search(spark, monkeypatch):
    # Families of copies, some of them linked by a chain only, beside texts that share a long passage and are not near.
    draw = random.Random(80)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, made = new(60), []
    for _ in range(12):
        now = new(100)
        for _ in range(draw.randint(1, 12)):
            made.append(" ".join(now))
            for _ in range(draw.randint(0, 2)):
                now[draw.randrange(100)] = f"x{draw.randrange(10**6)}"
    made += [" ".join(passage + new(40)) for _ in range(60)]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(made)])
    exact = {r["doc_id"]: r["component_id"] for r in similar.groups(docs).collect()}
    found = {r["id"]: r["component"] for r in near.groups(docs).collect()}
    linked = [i for i in exact if exact[i] != i]
    assert len(linked) > 40 and sum(found[i] == found[exact[i]] for i in linked) >= 0.99 * len(linked)
    prints = [print_by_hand(t, n) for t in made for n in (4, 5)]
    for a, b in itertools.combinations(range(len(made)), 2):  # and nothing else is joined, but by fingerprints
        if exact[a] != exact[b] and found[a] == found[b]:
            assert any((prints[2 * x + k] ^ prints[2 * y + k]).bit_count() <= 4 for x in range(len(made)) for y in range(x) for k in (0, 1) if found[x] == found[y] == found[a] and exact[x] != exact[y])


def test_rows_that_repeat_a_key(spark):
    one, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, one, "s"), (1, other, "s"), (2, one, "t"), (3, one, "a"), (1, one, "r"), (1, one, "s"), (None, one, "s"), (None, one, "s"), (5, None, "s"), (6, "", "s")]
    docs = documents(spark, rows)
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in near.one_of_each(docs).collect())
    assert got == sorted([(0, one, "s"), (0, one, "s"), (1, one, "r"), (1, other, "s"), (5, "", "s")])
    assert near.one_of_each(docs).columns == docs.columns and near.one_of_each(docs.limit(0)).count() == 0
    assert sorted(r["text"] for r in simhash.one_of_each(docs).filter("doc_id = 1").collect()) == [one, other]


# 9


def statistics_by_hand(text):
    w = words(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_statistics_by_brute_force(spark, odd):
    more = ["a a a a", "a b c", "a b c a b c", "a b a b a", "x\n\nx\n \n x\nx", "é# é* 𝄞|", "q q \x0b w"]
    frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    expected = collections.Counter((r["doc_id"], *statistics_by_hand(r["text"] or "")) for r in frame.collect())
    got = rules.statistics(frame).select("doc_id", *rules.STATISTICS).collect()
    assert collections.Counter(tuple(r) for r in got) == expected


def test_rules_find_the_bad_and_keep_the_good():
    draw = np.random.default_rng(9)
    n = 900
    values = {f: draw.random(n) for f in rules.FEATURES}
    bad = (values["symbols_per_word"] > 0.8) & (values["n_words"] > 0.3) | (values["duplicate_lines"] > 0.95)
    held = np.arange(n) % 3 == 0
    found = rules.covering(values, bad, held, precision=0.98, support=5)
    hit = np.zeros(n, bool)
    for rule in found:
        hit |= rules._all(rule, values)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.02 * hit.sum()
    assert rules.covering(values, draw.random(n) < 0.1, held, 0.98, 5) == []  # nothing to learn: nothing is rejected


def test_kept_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    junk = " ".join(f"w{i}###" for i in range(80))
    rows = [(i, (junk if i % 3 == 0 else good) + f" n{i}", "a") for i in range(90)] + [(90, None, "a"), (91, "short", "a"), (92, "a b c " * 100, "a"), (None, good, "a"), (None, good, "a")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), "x") for i in range(90)] + [(None, 0, "x"), (5, None, "x"), (1000, 0, "x")], "doc_id long, quality int, n_words string")
    kept = rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, -1, *[i for i in range(90) if i % 3]]
    assert rules.kept_documents(docs, labels.limit(0)).count() == 92 and rules.kept_documents(docs.limit(0), labels).count() == 0


# 10


def test_scan_stitches_blocks_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "LEVEL", 2)
    draw = random.Random(10)
    stream, lengths = [], []
    for _ in range(120):
        n = draw.choice([0, 0, 1, 2, 5, 40])
        lengths.append(n)
        stream += [draw.randint(0, 9) for _ in range(n)] + [tokens.END]
    stream += [1, 2, 3]  # never closed
    cuts = sorted(draw.sample(range(1, len(stream)), 4))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(stream)])):
        (tmp_path / f"tokens-{k:08d}.bin").write_bytes(np.array(stream[a:b], tokens.TOKEN).tobytes())
    got = sorted(tokens.count(spark, f"file://{tmp_path}", block=7).collect(), key=lambda r: r["document"])
    assert [r["document"] for r in got] == list(range(121))
    assert [r["n_tokens"] for r in got] == [*lengths, 3] and [r["closed"] for r in got] == [True] * 120 + [False]


def test_counts_are_those_of_the_tokenizer(spark, odd):
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary file")
    encode = tokens.encoder()()
    expected = collections.Counter((r["doc_id"], len(encode(r["text"] or ""))) for r in odd.collect())
    assert collections.Counter(tuple(r) for r in tokens.document_counts(odd).collect()) == expected


# pipeline


def test_pipeline_stage_by_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        place = scratch_folder(spark, "stage")
        stage(spark, docs, folder).write.parquet(place)
        docs = spark.read.parquet(place)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns and len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= set(left)
        now = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality rules":
            failed = {i for i, t in left.items() if (s := statistics_by_hand(t or ""))[0] < 50 or 100 * s[4] > 50 * s[0]}
            assert not failed & set(now)
        if name == "simhash near-dedup":
            # What the stage promises: the first of every group that such fingerprints or 0.8 of the five-word shingles join, and no other.
            prints = [{i: print_by_hand(t, n) for i, t in left.items()} for n in (4, 5)]
            sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for i, t in left.items()}
            group = {i: i for i in left}

            def root(x):
                while group[x] != x:
                    x = group[x]
                return x

            for a, b in itertools.combinations(sorted(left), 2):
                if any((p[a] ^ p[b]).bit_count() <= 4 for p in prints) or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[max(root(a), root(b))] = min(root(a), root(b))
            assert set(now) == {root(i) for i in left} and len(now) < len(left)
        if name == "personal data":
            assert all(now[i] == left[i] for i in now if not base_by_hand(left[i])) and not any(base_by_hand(t) for t in now.values())
        if name == "mixing":
            assert all(r["text"] == left[r["doc_id"]] for r in rows)
        left = now
