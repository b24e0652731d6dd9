"""Filter audit, odd sketches and the prefix trie against SQL and brute force, on tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from conftest import SMALL
from oracle import connect, rows

from matchforge.llm import audit, oddsketch, queries, tries

DOCS = "doc_id bigint, text string, lang string, source string, part string, n bigint"
LABELS = "doc_id bigint, quality int, toxic int"
TURNS = "conv_id bigint, turn bigint, role string, text string, depth bigint, node string"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_odd_sketches", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = connect(SMALL).execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


# ---- filter audit


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    firsts = {}
    for d, text, *_ in docs:
        if d is not None:
            firsts[text or ""] = min(firsts.get(text or "", d), d)
    failing = []
    for d, text, lang, *_ in docs:
        text = text or ""
        words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        fails |= {"E"} if d is not None and d > firsts[text] else set()
        failing.append((lang or "", fails, d in good, d in toxic))
    found = set()
    for part in {x[0] for x in failing}:
        rest_of = {}
        removed_by = Counter()
        for order in permutations("ABCDE"):
            rest = [x for x in failing if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in rest if f in x[1]]
                earlier = [x for x in failing if x[0] == part and f in x[1] and x not in rest]
                rest = [x for x in rest if f not in x[1]]
                removed_by[f] += len(gone)
                alone = sum(x[0] == part and x[1] == {f} for x in failing)
                rest_of["".join(order), step] = (len(rest), len(gone), len(earlier), alone, sum(x[2] for x in gone), sum(x[3] for x in gone))
        found |= {(part, order, step, *values, removed_by[order[step - 1]]) for (order, step), values in rest_of.items()}
    return found


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = [
        (1, None, None, "s", "x", 1), (2, "", "en", None, None, None), (2, "", "en", None, None, None), (None, "", "en", "", "", 0), (None, "Same text", "de", "", "", 0),
        (5, "Same text", "en", "", "", 0), (4, "Same text", "", "", "", 0), (6, long, "en", "", "", 0), (7, long + " #", "en", "", "", 0), (8, "AAA\x0bbbb\x0cAAA x", "en", "", "", 0),
        (9, "\U0001f600" * 5 + "A", "en", "", "", 0), (10, "a " * 200, "de", "", "", 0), (10, "other", "de", "", "", 0), (10, "other", "de", "", "", 0),
    ]
    labels = [(2, 1, None), (2, 0, 1), (4, None, None), (6, 1, 0), (7, 0, 1), (99, 1, 1), (None, 1, 1)]
    got = audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    # documents are told apart by object in the plain version, so equal rows count as often as they stand there
    assert {tuple(r) for r in got} == plain_audit(docs, [x for x in labels if x[0] is not None])
    assert len(got) == 600 * 3


def test_audit_of_empty_tables(spark):
    none = audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert none.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert none.collect() == []
    assert audit.filter_audit(spark.createDataFrame([(1, "a", "en", "", "", 0)], DOCS), spark.createDataFrame([], LABELS)).filter("good_lost + toxic_lost <> 0").count() == 0


# ---- odd sketches


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} if words else set()


def plain_components(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies(n, seed, words=120):
    """Groups of near copies, of copies of copies, of texts with a common passage, and strangers."""
    own = random.Random(seed)

    def fresh(k):
        return [f"{own.choice('abcdefgh')}{own.randrange(4000)}" for _ in range(k)]

    passage, texts = fresh(60), []
    base = fresh(words)
    while len(texts) < n:
        kind = own.random()
        if kind < 0.6:
            copy = list(base)
            for _ in range(own.randrange(6)):
                copy[own.randrange(len(copy))] = fresh(1)[0]
            texts.append(copy)
            base = copy if own.random() < 0.05 else base
        elif kind < 0.8:
            texts.append(passage + fresh(own.randrange(5, 60)))
        else:
            texts.append(fresh(own.randrange(0, 80)))
            base = texts[-1] if own.random() < 0.2 and len(texts[-1]) > 40 else base
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("bucket", "members", "pivots"), [(4096, 256, 32), (7, 9, 3), (5, 4, 0)])
def test_components_equal_all_pairs(spark, monkeypatch, bucket, members, pivots):
    """In one block, in many with pivots, and in many without: the same components as all pairs give."""
    for name, value in (("BUCKET_BLOCK", bucket), ("CLASS_BLOCK", members), ("PIVOTS", pivots)):
        monkeypatch.setattr(oddsketch, name, value)
    texts = near_copies(400, 3)
    component, n = plain_components(texts)
    got = oddsketch.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(i, n[i], c, i == c) for i, c in enumerate(component)]
    assert len(set(component)) < 320 and max(Counter(component).values()) > 20


def test_sketches_estimate_similarities():
    own = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.9, 0.97):
        apart = []
        for _ in range(40):
            whole = own.integers(0, 2**63, 500, dtype=np.uint64)
            rest = round(500 * (1 - share) / 2)
            a, b = np.sort(whole[rest:]), np.sort(whole[: 500 - rest])
            x, y = (np.frombuffer(oddsketch.odd_sketch(oddsketch.samples(s)), np.uint64) for s in (a, b))
            apart.append(int(np.bitwise_count(x ^ y).sum()))
        estimate = 1 + oddsketch.BITS / (4 * oddsketch.SAMPLES) * np.log(1 - 2 * np.mean(apart) / oddsketch.BITS)
        assert abs(estimate - share) < 0.02
        assert share < 0.8 or max(apart) <= oddsketch.FAR


def test_links_cost_a_forest_in_a_group_of_copies(monkeypatch):
    """Near copies are connected by one comparison each, not by their pairs."""
    sets = [oddsketch.shingle_set(t.encode()) for t in ("one two three four five six seven eight nine ten " * 1 + f"x{i}" for i in range(300))]
    sketches = np.stack([np.frombuffer(oddsketch.odd_sketch(oddsketch.samples(s)), np.uint64) for s in sets])
    compared = Counter()
    plain = np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda a, b, assume_unique: (compared.update(n=1), plain(a, b, assume_unique=assume_unique))[1])
    sets = [np.union1d(s, np.arange(100, dtype=np.uint64)) for s in sets]
    assert len(oddsketch.linked(sketches, sets, np.arange(300), np.ones(300, bool))) == 299
    assert compared["n"] <= 2 * 300


def test_odd_rows_of_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = [
        (3, None), (4, ""), (5, " \t\n"), (7, "One two"), (6, "one  two"), (8, "one two three"), (None, "one two"), (None, "nobody knows this"), (None, None),
        (9, long), (10, long + " end"), (11, "a b c d e f"), (11, "a b c d e f"), (11, "quite another text than that"), (12, "quite another text than that"), (1, "É É a b c"), (2, "é é a b c"),
    ]
    frame = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in docs], "doc_id bigint, text string, node bigint, digest string, component string")
    got = Counter(tuple(r) for r in oddsketch.near_duplicates(frame).collect())
    assert got == Counter(
        [
            (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 1, 6, False), (6, 1, 6, True), (8, 1, 8, True), (None, 1, 6, False), (None, 1, None, True), (None, 0, None, True),
            (9, 199_997, 9, True), (10, 199_998, 9, False), (11, 3, 11, True), (11, 3, 11, True), (11, 2, 11, True), (12, 2, 11, False), (1, 2, 1, True), (2, 2, 2, True),
        ]
    )
    assert oddsketch.near_duplicates(frame.limit(0)).collect() == []
    assert [tuple(r) for r in oddsketch.near_duplicates(frame.filter("text is null and doc_id = 3")).collect()] == [(3, 0, 3, True)]


# ---- prefix trie


def plain_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text, *_ in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    found = set()
    for node, of in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in under if n)
        ends = ",".join(str(c) for c in sorted(of) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        found.add((min(of), len(node), parent, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return found


def test_trie_of_odd_rows(spark):
    own = random.Random(4)
    turns = [(c, t, own.choice(["user", "bot", None]), own.choice(["hello there", "hi", "", None, "one two three"]), 5, "x") for c in range(0, 90) for t in range(own.randrange(1, 5)) if c != 40]
    turns += [(19, None, None, None, 0, ""), (19, None, "user", "first", 0, ""), (19, 2, "user", "tie", 0, ""), (19, 2, "user", "tie", 0, ""), (None, 1, "user", "nobody", 0, "")]
    turns += [(200 + c, t, "user", "same " * (t + 1), 0, "") for c in range(60) for t in range(3)] + [(300, t, "user", f"{t} " * 40, 0, "") for t in range(300)] + [(500, 0, "user", "word " * 200_000, 0, "")]
    got = [tuple(r) for r in tries.prefix_trie(spark.createDataFrame(turns, TURNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(turns)


def test_ends_of_a_common_conversation_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tries, "JOINED", 7)
    turns = [(20 * c, t, "user", "same text", 0, "") for c in range(500) for t in range(4)]
    got = tries.prefix_trie(spark.createDataFrame(turns, TURNS)).orderBy("depth").collect()
    assert [r.n_convs for r in got] == [500] * 5
    assert got[-1].ends_sha256 == hashlib.sha256(",".join(str(20 * c) for c in range(500)).encode()).hexdigest()
    assert got[0].saved_tokens == 499 * 2 * 4


def test_trie_without_rows_or_turns(spark):
    assert tries.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    alone = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    got = tries.prefix_trie(spark.createDataFrame([(alone, 0, "user", "gone", 0, "")], TURNS)).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
