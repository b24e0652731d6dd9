"""Operators that rest on a mechanism of their own, against plain versions and on hot groups."""

import itertools
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchforge.functions import text, words
from matchforge.operators import cards, fitting, knn, order, pages, ranking, recommend, resolution, sampling, textsearch
from matchforge.operators.rules import Rules
from matchforge.plans import registry, texts
from matchforge.streaming import harvest, memory

CARD = "slug string, title string, manufacturer string, grapes array<string>, sweetness string, colour string, alcohol double"
SHORT = "query_id string, slug string, place int, inliers int, cv double, coverage double"
READ = "query_id string, token string, conf double"
LABEL = "query_id string, read struct<years:array<string>,sweetness:string,colour:string,alcohol:double>"


def tables(spark, cases):
    """Shortlists, cards, read tokens and labels of cases by name: (titles by slug in order of place, inliers, read, makers, (sweetness, colour))."""
    short, own, read, labels = [], [], [], []
    for q, (titles, inliers, tokens, maker, label) in cases.items():
        makers = maker if isinstance(maker, dict) else dict.fromkeys(titles, maker)
        own += [(f"{q}-{s}", t, makers[s], [], None, "белое" if t.endswith("белое") else None, None) for s, t in titles.items()]
        short += [(q, f"{q}-{s}", k, inliers[k], 0.9 - k / 100, 0.5) for k, s in enumerate(titles)]
        read += [(q, t, c) for t, c in tokens]
        labels.append((q, ([], *label, None)))
    return tuple(spark.createDataFrame(rows, schema) for rows, schema in ((short, SHORT), (own, CARD), (read, READ), (labels, LABEL)))


def settled(spark, cases, rules):
    got = defaultdict(list)
    for r in resolution.settled(*tables(spark, cases), rules).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.slug.removeprefix(f"{r.query_id}-"), r.reasons))
    return dict(got)


# ---- resolution

TWO, NONE, HOUSE = {"a": "Кокур", "b": "Мускат"}, (None, None), "Массандра"
NAMES = {"a": "Кагор", "b": "Портвейн красный Ливадия", "c": "Портвейн белый крымский"}
WINES, MAKERS = {"a": "Марселан", "b": "Мерло", "c": "Рислинг"}, {"a": "Мысхако", "b": "Inkerman", "c": "Golubitskoe Estate"}


def test_settling(spark):
    cases = {
        # a word that some of the group have speaks against the others; stop words of cards and everyone's maker don't
        "missing": ({**TWO, "c": "Мускат игристое", "d": "Мадера"}, [50, 45, 44, 3], [("мускат", 0.9), ("крым", 0.95), ("массандра", 0.95)], HOUSE, NONE),
        "twice": (TWO, [50, 45], [("мускат", 0.9), ("мускат", 0.9)], HOUSE, NONE),
        "far-ahead": (TWO, [50, 10], [("муск", 0.9)], HOUSE, NONE),
        "strong-name": (NAMES, [65, 46, 15], [("крымский", 0.95)], HOUSE, NONE),
        "maker": (WINES, [60, 20, 10], [("inkerman", 0.7)], MAKERS, NONE),
        "maker-in-other-letters": (WINES, [60, 20, 10], [("голубицкое", 0.95)], MAKERS, NONE),
        "two-makers": (WINES, [60, 20, 10], [("inkerman", 0.9), ("мысхако", 0.9)], MAKERS, NONE),
        "nothing-read": (TWO, [50, 45], [], HOUSE, NONE),
        "no-points": (TWO, [0, 0], [("мускат", 0.9)], HOUSE, NONE),
        "one-card": ({"a": "Кокур"}, [5], [("мускат", 0.9)], None, NONE),
        "contradicted": ({"a": "А белое", "b": "Б", "c": "В"}, [20, 5, 47], [], HOUSE, ("брют", "красное")),
    }
    assert settled(spark, cases, Rules()) == {
        "missing": [("b", 0), ("c", 0), ("d", 0), ("a", 1)],
        "twice": [("b", 0), ("a", 2)],
        "far-ahead": [("a", 0), ("b", 0)],
        "strong-name": [("c", 0), ("a", 1), ("b", 1)],
        "maker": [("b", 0), ("a", 0), ("c", 0)],
        "maker-in-other-letters": [("c", 0), ("a", 0), ("b", 0)],
        "two-makers": [("a", 0), ("b", 0), ("c", 0)],
        "nothing-read": [("a", 0), ("b", 0)],
        "no-points": [("a", 0), ("b", 0)],
        "one-card": [("a", 0)],
        "contradicted": [("b", 0), ("a", 0), ("c", 0)],
    }


def test_settling_by_other_rules(spark):
    cases = {
        "strong-name": (NAMES, [65, 46, 15], [("крымский", 0.95)], HOUSE, NONE),
        "maker": (WINES, [60, 20, 10], [("inkerman", 0.9)], MAKERS, NONE),
        "votes": ({"a": "Портвейн белый Гурзуф", "b": "Портвейн белый Алушта", "c": "Портвейн красный Алушта"}, [121, 59, 40], [("портвейн", 0.9), ("беаый", 0.9), ("аушта", 0.9)], HOUSE, NONE),
        "contradicted": ({"a": "А белое", "b": "Б", "c": "В"}, [20, 5, 47], [], HOUSE, ("брют", "красное")),
    }
    got = settled(spark, cases, Rules(name_first=False, name_strong=False, brand_first=False, text_vote=0.2, demote_geometry=True))
    assert {q: "".join(s for s, _ in rows) for q, rows in got.items()} == {"strong-name": "abc", "maker": "abc", "votes": "bac", "contradicted": "cba"}


def test_series_rivals_ask_for_a_confirming_word(spark):
    """Two rivals of the leader's series crowd it though its inliers are far ahead; a word of its own lifts the caveat."""
    titles = {"a": "Брюле розовое", "b": "Брюле кюве", "c": "Брюле мускат"}
    cases = {"silent": (titles, [94, 60, 50], [("брюле", 0.9)], HOUSE, NONE), "told": ({k: titles[k] for k in "bac"}, [94, 60, 50], [("брюле", 0.9), ("кюве", 0.9)], HOUSE, NONE)}
    made = tables(spark, cases)
    assert {r.slug for r in cards.series_rivals(*made[:2]).filter("query_id = 'silent'").collect()} == {"silent-b", "silent-c"}
    got = {r.query_id: (r.slug[-1], r.confirmed, r.state) for r in resolution.answered(*made, Rules(confident=0.0, show=0.0)).collect()}
    assert got == {"silent": ("a", 0, "uncertain"), "told": ("b", 1, "confident")}


def test_rules_from_switches():
    rules = Rules.from_switches({"KIN_GROUP": "1", "NAME_FIRST": "0", "TEXT_VOTE": "0.2", "GEOMETRY_MARGIN": "0.3", "SIFT_MAX_SIDE": "900", "DEMOTE_DEPTH": "1"})
    assert rules.kin_group and not rules.name_first and rules.text_vote == 0.2 and rules.margin == 0.3 and rules.demote_depth and rules.recorded == (("SIFT_MAX_SIDE", "900"),)
    assert Rules.from_switches({}) == Rules() and len(words.RULE_SWITCHES) == 25
    with pytest.raises(ValueError, match="no such switch"):
        Rules.from_switches({"TEXT_VOTES": "1"})


# ---- near words


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def misread(own, word):
    letters = list(word)
    for _ in range(own.randrange(5)):
        at = own.randrange(len(letters)) if letters else 0
        kind = own.randrange(4)
        if kind == 0 and letters:
            letters[at] = own.choice("абвг")
        elif kind == 1 and letters:
            del letters[at]
        elif kind == 2:
            letters.insert(at, own.choice("абвг"))
        elif at + 1 < len(letters):
            letters[at], letters[at + 1] = letters[at + 1], letters[at]
    return "".join(letters)


@pytest.fixture(scope="module")
def vocabulary():
    own = random.Random(11)
    known = {"".join(own.choice("абвгдежз") for _ in range(own.randrange(1, 24))) for _ in range(250)}
    read = {misread(own, w) for w in known for _ in range(2)} | {"".join(own.choice("абвгдежз") for _ in range(own.randrange(1, 24))) for _ in range(60)}
    return sorted(known), sorted(read | {""})


def test_near_tokens_equal_all_pairs(spark, vocabulary):
    known, read = vocabulary
    got = textsearch.near_tokens(spark.createDataFrame([(r,) for r in read], "token string"), spark.createDataFrame([(k,) for k in known], "word string"), 0.2)
    want = {(r, k) for r in read for k in known if osa(r, k) <= 0.2 * max(len(r), len(k)) + 1e-9}
    assert {tuple(r) for r in got.collect()} == want
    assert sum(len(r) > 14 for r, _ in want) > 20 and len(want) > 200


def test_close_spellings_equal_all_pairs(spark, vocabulary):
    import difflib

    known, read = vocabulary
    got = textsearch.close_spellings(spark.createDataFrame([(r,) for r in read if r], "token string"), spark.createDataFrame([(k,) for k in known], "word string"))
    want = {(r, k) for r in read for k in known if r and difflib.SequenceMatcher(None, r, k).ratio() >= 0.8}
    assert {(r.token, r.word) for r in got.collect()} == want


def test_candidates_of_a_token_are_few(spark):
    """Of 4 000 random words a token meets some, where lengths alone would let a fifth of all through."""
    own = random.Random(2)
    known = sorted({"".join(own.choice("абвгдежзиклмнопрст") for _ in range(own.randrange(5, 13))) for _ in range(4000)})
    words_ = spark.createDataFrame([(k,) for k in known], "word string")
    tokens = spark.createDataFrame([(k,) for k in known[::20]], "token string")
    met = textsearch.nearby(tokens, words_, 0.8, 2, 14, lambda n, m: F.lit(4))
    assert met.count() < 20 * tokens.count()


# ---- order statistics


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_ranks_of_a_hot_group(spark, partitions):
    own = random.Random(6)
    rows = [("hot", own.randrange(50) / 7) for _ in range(3000)] + [("hot", None)] * 5 + [(None, 1.0), (None, 3.0)] + [("one", 4.0)] + [("same", 2.0)] * 400
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(rows, "g string, v double")
        n = F.col("n")
        got = {r.g: r for r in order.at_ranks(frame, "g", "v", {"low": F.lit(1), "high": n, "upper": F.floor(n / 2) + 1, "none": n + 1, "p95": order.nearest_rank(n, 0.95)}).collect()}
        shares = {r.g: r for r in order.percentiles(frame, "g", "v", {"median": 0.5, "p9": 0.9}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        s, r = sorted(values), got[g]
        assert (r.n, r.low, r.high, r.upper, r.none) == (len(s), s[0], s[-1], s[len(s) // 2], None)
        assert r.p95 == s[int(np.ceil(0.95 * len(s))) - 1]
        assert np.isclose(shares[g].median, np.quantile(s, 0.5)) and np.isclose(shares[g].p9, np.quantile(s, 0.9))


def test_ranks_of_nothing(spark):
    assert order.at_ranks(spark.createDataFrame([], "g string, v double"), "g", "v", {"first": F.lit(1)}).collect() == []


# ---- nearest rows in cells


def test_a_query_takes_its_depth_from_a_cell_and_no_more(spark, monkeypatch):
    """Exchange rows are cells x queries x depth though a third of the index is one vector."""
    monkeypatch.setattr(knn, "CELL_ROWS", 100)
    own = np.random.default_rng(1)
    vectors = own.normal(size=(600, 8))
    vectors[::3] = vectors[0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    index = spark.createDataFrame([(i, None if i % 50 == 7 else f"k{i % 200}", i % 2, v.tolist()) for i, v in enumerate(vectors)], "row_id bigint, slug string, view bigint, embedding array<double>")
    queries = index.filter("row_id % 40 = 0").selectExpr("row_id AS query_id", "embedding")
    cells, asked = knn.cells_of(index), queries.count()
    assert cells == 6
    sent = knn._scan(index, queries, lambda similar, _: knn.best_places(similar, 5))
    assert sent.count() <= cells * asked * 5
    similar = np.round(vectors[::40] @ vectors.T, 9)
    got = defaultdict(list)
    for r in knn.top_rows(index, queries, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.row_id)
    assert got == {40 * q: sorted(range(600), key=lambda i: (-similar[q, i], i))[:5] for q in range(asked)}
    best = defaultdict(list)
    for r in knn.placed(knn.best_by_key(index, queries, 7)).orderBy("query_id", "place").collect():
        best[r.query_id].append((r.slug, r.row_id))
    for q in range(asked):
        first = {}
        for i in sorted((i for i in range(600) if i % 50 != 7), key=lambda i: (-similar[q, i], i)):
            first.setdefault(f"k{i % 200}", i)
        assert best[40 * q] == list(first.items())[:7]
    assert knn.top_rows(index.limit(0), queries, 5).count() == 0 and knn.top_rows(index, queries.limit(0), 5).count() == 0


# ---- robust fits and pairs


def test_transforms_are_found_among_wrong_matches(spark):
    own = np.random.default_rng(4)
    rows, want = [], {}
    for pair, (n, good) in enumerate([(60, 45), (30, 20), (8, 8), (7, 7)]):
        h = np.array([[1.1, 0.1, 5 * pair], [-0.1, 0.9, 20], [2e-4, -1e-4, 1]])
        for m in range(n):
            x, y = own.uniform(0, 400, 2)
            p = h @ [x, y, 1]
            u, v = (p[:2] / p[2] + own.uniform(-0.4, 0.4, 2)) if m < good else own.uniform(1000, 4000, 2)
            rows.append((pair, m, float(x), float(y), float(u), float(v)))
        want[pair] = good if n >= 8 else 0
    rows += [(9, m, float(m), 2.0 * m, 3.0 * m, 1.0 * m) for m in range(20)] + [(8, m, 1.0, 1.0, 1.0, 1.0) for m in range(20)]  # on a line; one point
    frame = spark.createDataFrame(rows, "pair_id int, match_id int, x double, y double, u double, v double")
    got = fitting.explained(frame)
    assert got.count() == len(rows)
    assert {r.pair_id: r.inliers for r in fitting.fit_report(frame).collect()} == want | {8: 0, 9: 0}
    assert got.filter("inlier").groupBy("pair_id").agg(F.max("match_id")).filter("pair_id = 0").first()[1] < 45


def test_transforms_are_not_bent_towards_wrong_matches(spark):
    """Three wrong matches lie side by side just out of reach: a transform between them and the right ones would explain all."""
    own = np.random.default_rng(12)
    rows = []
    for pair in range(20):
        for m in range(15):
            x, y = own.uniform(0, 400, 2)
            rows.append((pair, m, float(x), float(y), float(x + (7 if m >= 12 else 0)), float(y)))
    frame = spark.createDataFrame(rows, "pair_id int, match_id int, x double, y double, u double, v double")
    assert {r.inliers for r in fitting.fit_report(frame).collect()} == {12}


def test_matches_on_the_edge_of_the_reach_are_explained(spark):
    own = np.random.default_rng(13)
    rows = []
    for pair in range(40):
        for m in range(24):
            x, y = (0.0, 10.0 * (m - 20)) if m >= 20 else own.integers(0, 400, 2).astype(float)
            w, off = 1 + x * 0.0004, ((3, 4), (5, 0), (0, -5), (-4, 3))[m - 20] if m >= 20 else (0, 0)
            rows.append((pair, m, float(x), float(y), float((x * 1.1 + y * 0.1 + pair) / w + off[0]), float((y * 0.9 - x * 0.1 + 60) / w + off[1])))
    frame = spark.createDataFrame(rows, "pair_id int, match_id int, x double, y double, u double, v double")
    assert {r.inliers for r in fitting.fit_report(frame).collect()} == {24}


def test_closed_form_equals_a_linear_solution(spark):
    own = np.random.default_rng(8)
    src, dst = own.uniform(0, 100, (4, 2)), own.uniform(0, 100, (4, 2))
    row = {f"{c}{i}": float(p[i][k]) for p, cs in ((src, "xy"), (dst, "uv")) for k, c in enumerate(cs) for i in range(4)}
    got = fitting.transforms(spark.createDataFrame([row | {"k": 1}]), "k").first()
    h = np.array([got[c] for c in fitting.H]).reshape(3, 3)
    for (x, y), d in zip(src, dst, strict=True):
        p = h @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], d, atol=1e-6)


def test_strangers_of_a_hot_stratum(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RING", 64)
    rows = [(i, "hot", f"g{i % 7}") for i in range(900)] + [(1000 + i, "small", "g") for i in range(5)] + [(2000, "one", "x")] + [(3000 + i, None, None if i % 2 else "y") for i in range(10)]
    frame = spark.createDataFrame(rows, "k bigint, s string, g string")
    got = [tuple(r) for r in sampling.strangers(frame, "k", "s", "g", 3).collect()]
    assert sorted(got) == sorted(tuple(r) for r in sampling.strangers(frame.repartition(7), "k", "s", "g", 3).collect())
    of = {k: (s, g) for k, s, g in rows}
    assert len(set(got)) == len(got) and all(of[a][0] == of[b][0] and of[a][1] != of[b][1] for a, b in got)
    hot = [a for a, _ in got if a < 900]
    assert 0.75 * 2700 < len(hot) <= 2700 and not {a for a, _ in got} & set(range(1000, 2001))


def test_pairs_of_the_right_row_and_every_other(spark):
    rows = [("a", True, 1, 5.0), ("a", True, 2, 9.0), ("a", False, 3, 1.0), ("a", False, 4, 2.0), ("b", False, 5, 3.0), ("c", True, 6, 1.0), ("c", False, 7, 4.0)]
    got = sampling.against_the_right(spark.createDataFrame(rows, "g string, ok boolean, k int, f double"), "g", "ok", "k", ["f"], 5).collect()
    assert sorted((r.g, r.f) for r in got) == [("a", 3.0), ("a", 4.0), ("c", -3.0)]
    assert len({(r.g, r.fold) for r in got}) == 2


# ---- streams


def landed(spark, folder, parts, schema):
    """A folder of one Parquet file a batch, read in that order one file at a time."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_memory_over_batches_equals_a_plain_loop(spark, tmp_path):
    own = random.Random(9)
    parts = [[(own.randrange(3), f"k{own.randrange(30)}", 100 * b + own.randrange(120)) for _ in range(60)] + [(None, "x", 5), (1, None, 5), (1, "y", None)] for b in range(3)]
    stream = landed(spark, str(tmp_path / "events"), parts, "user bigint, k string, at bigint")
    got = {}
    for r in memory.memory_after(spark, stream, "user", "k", "at", kept=8).orderBy("user", "place").collect():
        got.setdefault(r.user, []).append((r.k, r["at"]))
    want = {u: {} for u in range(3)}
    for part in parts:
        for u, k, at in part:
            if u is not None and k is not None and at is not None:
                want[u][k] = max(at, want[u].get(k, at))
        want = {u: dict(sorted(sorted(m.items()), key=lambda e: -e[1])[:8]) for u, m in want.items()}
    assert got == {u: list(m.items()) for u, m in want.items()}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    target = str(tmp_path / "rows")
    write = harvest.appended_once(target, "id")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id bigint, v string")
    second = spark.createDataFrame([(2, "later"), (3, "e")], "id bigint, v string")
    for batch, number in ((first, 0), (second, 1), (first, 0), (second, 1), (second.limit(0), 2)):
        write(batch, number)
    assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_harvest_keeps_no_state(spark, tmp_path):
    spark.createDataFrame([(i % 50, str(i)) for i in range(200)], "id bigint, v string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        harvest.harvested(spark, str(tmp_path / "in"), str(tmp_path / "out"), "id", str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    assert not (tmp_path / "checkpoint" / "state").exists()


# ---- pages


def test_sitemaps_and_what_they_differ_in(spark, tmp_path):
    page = "<url><loc> https://x.example/items/{0}{2} </loc><lastmod>{1}</lastmod></url>"
    for name, entries in (("old", [("a", "2024-01-01", ""), ("b", "2024-01-01", "/"), ("c", "2024-01-01", "")]), ("new", [("a", "2024-01-01", ""), ("b", "2024-02-01", ""), ("d", "", "")])):
        (tmp_path / f"{name}.xml").write_text("<urlset>" + "".join(page.format(*e) for e in entries) + "</urlset>")
    old, new = (pages.sitemap(spark, str(tmp_path / f"{n}.xml")) for n in ("old", "new"))
    assert {tuple(r) for r in pages.snapshot_diff(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "new")}


def test_payloads_within_eight_wrappers(spark):
    wrapped = ",".join(f'["Ref",{k}]' for k in range(4, 11))
    rows = [(1, "s", f'[{{"slug":1,"title":2,"manufacturer":3}},"s","t",{wrapped},"m"]')]
    assert pages.payload_cards(spark.createDataFrame(rows, "page_id bigint, slug string, payload string")).first().maker == "m"


# ---- labels


def test_sweetness_and_colour(spark):
    cases = {
        "Полу сухое красное": ("полусухое", "красное"), "Extra Brut": ("экстра брют", None), "брют натюр BLANC": ("экстра брют", "белое"), "несухое": (None, None),
        "demi sec rose": ("полусухое", "розовое"), "сухое полусладкое": ("полусладкое", None), "": (None, None),
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.sweetness(text.clean(F.col("t"))).alias("s"), text.colour(text.clean(F.col("t"))).alias("c"))
    assert {r.t: (r.s, r.c) for r in frame.collect()} == cases
    assert {"demi", "sec", "полусухое", "rosso", "роза"} <= set(text.category_words())


def plain_analogs(items, sources, limit=6):
    """Source by source, item by item."""
    found = []
    for s in sources:
        series, few = {}, defaultdict(list)
        for c in sorted(items, key=lambda c: c["row_id"]):
            styles = [(s[f], c[f]) for f in ("colour", "sparkling", "sweetness")]
            sweet = s["sweetness"] is None or c["sweetness"] is None or s["sweetness"] == c["sweetness"]
            if c["slug"] != s["slug"] and (s["maker"] is None or c["maker"] not in (None, s["maker"])) and all(a is None or a == b for a, b in styles[:2]) and sweet:
                series.setdefault((c["maker"], c["title"]), c)
        for c in series.values():
            common = set(c["varieties"]) & set(s["varieties"])
            score = 3.0 * len(common) / len(set(c["varieties"]) | set(s["varieties"])) + (s["sweetness"] is not None and c["sweetness"] == s["sweetness"]) + 0.5 * (c["region"] == s["region"]) + c["rating"] / 5.0
            if score > 1:
                few[c["maker"]].append((-score, c["slug"]))
        best = sorted(x for own in few.values() for x in sorted(own)[:2])[:limit]
        found += [(s["slug"], slug, rank) for rank, (_, slug) in enumerate(best, 1)]
    return found


@pytest.mark.parametrize("size", [200_000, 37])
def test_analogs_equal_a_plain_walk(spark, monkeypatch, size):
    """Unknown facets on both sides, long series, a style with most items, styles in several parts."""
    rng = random.Random(4)
    monkeypatch.setattr(recommend, "STYLE_ROWS", size)
    items = [
        {"slug": i, "row_id": (i * 77) % 400, "title": rng.choice("abcdefgh"), "maker": rng.choice(["m1", "m2", "m3", "m4", None]), "colour": rng.choice(["red", "red", "red", "?", None]), "sparkling": rng.choice([True, False, False, None]),
         "sweetness": rng.choice(["dry", "sweet", "?", None]), "region": rng.choice(["r1", "r2"]), "varieties": rng.sample(["v1", "v2", "v3", "v4"], 2), "rating": rng.randrange(51) / 10}
        for i in range(400)
    ]
    frame = spark.createDataFrame([tuple(x.values()) for x in items], "slug bigint, row_id bigint, title string, maker string, colour string, sparkling boolean, sweetness string, region string, varieties array<string>, rating double")
    found = recommend.analogs(frame, frame.filter("slug % 10 = 0"), 6, F.col("slug"))
    assert sorted((r["source"], r["slug"], r["rank"]) for r in found.collect()) == sorted(plain_analogs(items, items[::10]))
    assert recommend.analogs(frame, frame.limit(0)).count() == recommend.analogs(frame.limit(0), frame.limit(0)).count() == 0
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell", [131_072, 50])
def test_similarity_spread_equals_all_pairs(spark, monkeypatch, cell):
    """Negative, zero and equal similarities, rows of nobody's kin, a third of all rows alike."""
    rng = np.random.default_rng(7)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)
    vectors[:100] = vectors[0]
    vectors[250:] = rng.standard_normal((50, 4))
    kin = [[None if i % 17 == 0 else str(i % 4), None if i % 29 == 0 else str(i % 2)] for i in range(300)]
    index = spark.createDataFrame([(i, kin[i], v.tolist()) for i, v in enumerate(vectors)], "row_id bigint, kin array<string>, embedding array<double>").repartition(7)
    monkeypatch.setattr(knn, "CELL_ROWS", cell)
    monkeypatch.setattr(knn, "AREA", 500)
    found = knn.similarity_spread(index, index.filter("row_id % 3 = 0").withColumnRenamed("row_id", "query_id"), ["own", "near", "far"], [0.0, 0.37, 0.5, 0.9, 1.0])
    want = defaultdict(list)
    for q in range(0, 300, 3):
        for r in range(300):
            level = next((k for k in range(2) if kin[q][k] is not None and kin[q][k] == kin[r][k]), 2)
            if q != r:
                want[["own", "near", "far"][level]].append(vectors[q] @ vectors[r])
    assert [(name, n) for name, n, *_ in found] == [(name, len(want[name])) for name in ("own", "near", "far")]
    for name, _, mean, values in found:
        assert np.isclose(mean, np.mean(want[name])) and np.allclose(values, np.quantile(want[name], [0.0, 0.37, 0.5, 0.9, 1.0]), atol=1e-12)
    assert knn.similarity_spread(index.limit(0), index.limit(0).withColumnRenamed("row_id", "query_id"), ["own", "near", "far"], [0.5]) == []


def test_rank_keys_order_numbers():
    values = np.array([-np.inf, -2.5, -1.0, -1e-300, -0.0, 0.0, 5e-324, 0.5, 1.0, np.inf])
    keys = knn.rank_keys(values)
    assert list(keys) == sorted(keys) and keys[4] == keys[5] and len(set(keys)) == 9
    assert [knn.rank_value(int(k)) for k in keys] == [*values]


def test_best_of_all_needs_no_window_over_all(spark):
    rows = spark.range(1000).select(F.col("id").alias("slug"), (F.col("id") % 40).alias("maker"), (F.col("id") % 7).alias("score"))
    found = ranking.capped(rows, [], 2, 5, F.desc("score"), F.col("slug"))
    best = sorted(((i % 7, -i, i % 40) for i in range(1000)), reverse=True)
    makers, want = defaultdict(int), []
    for _, i, maker in best:
        makers[maker] += 1
        if makers[maker] <= 2:
            want.append(-i)
    assert [r["slug"] for r in found.orderBy("rank").collect()] == want[:5] and "TakeOrdered" in plan(found)


def test_sums_before_equal_a_plain_walk(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(9)) for i in rng.sample(range(10_000), 3_000)] + [(None, 4)]
    frame = spark.createDataFrame(rows, "id bigint, n int").repartition(9)
    total, want = 0, {}
    for i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        want[i], total = total, total + n
    found = order.summed_before(frame, F.col("id"), F.col("n"), "before")
    assert found.columns == ["id", "n", "before"] and {r["id"]: r["before"] for r in found.collect()} == want
    assert order.summed_before(frame.limit(0), F.col("id"), F.lit(1), "before").count() == 0


def test_siblings_are_all_pairs(spark, monkeypatch, tmp_path):
    """Different names of one series, a series in several parts, unknown makers and names, one item alone."""
    names = [("m", "the red ring"), ("m", "red ring"), ("m", "Red ring 12"), (None, "red ring"), (None, "red ring"), ("m", None), ("m", None), ("n", "red ring"), ("m", "red of\n"), ("m", "red\n")] + [("m", "bolt")] * 9
    folder = str(tmp_path)
    spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "p_partkey bigint, p_brand string, p_name string").repartition(3).write.parquet(folder + "/part.parquet")
    monkeypatch.setattr(texts, "SERIES_ITEMS", 4)
    found = sorted((r["a"], r["b"]) for r in texts.sibling_pairs(spark, folder).collect())
    assert found == sorted([*itertools.combinations(range(3), 2), *itertools.combinations(range(10, 19), 2)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    assert found == sorted(con.execute(registry.ORACLES["sibling_pairs"]).fetchall())
