"""Exact dedup by an index, importance resampling and the audit of sources: SQL, brute force, awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from strokemill.llm import dedupindex, divergence, registry, resampling
from strokemill.llm.common import shared_dir

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "x" * 50_000, "en", "a", 50_000),
    (4, "the cat and the dog", "en", None, 19),
    (4, "the cat and the dog", "en", None, 19),
    (5, "the  cat\nand the\tdog", "en", "b", 20),
    (None, "word " * 30, "fr", "b", 150),
    (None, "word " * 30, "fr", "b", 150),
    (6, "12 !? --", "fr", "b", 8),
    (7, "Été ÉTÉ\x00été ß", "fr", "c", 15),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, COLUMNS)


def fresh(spark, buckets=8):
    return dedupindex.DigestIndex(spark, f"{shared_dir(spark)}/index-{random.random()}", buckets)


@pytest.mark.parametrize("name", ["op11_digest_index", "op12_importance_resampling", "op13_source_divergence"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    done = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in done.description]
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(repr, r)) for r in done.fetchall()) and got


# -- 11


def kept_by_hand(rows):
    groups = {}
    for r in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(r[0])
    out = Counter()
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = min(known, default=None), False
        for i in ids:
            out[i, keep, len(ids), i == keep and not seen, digest] += 1
            seen = seen or i == keep
    return out


def resolved(spark, docs, *parts):
    rows = dedupindex.digests(docs)
    index = fresh(spark)
    for p in parts or ("true",):
        index.add(rows.filter(p))
    return Counter(tuple(r) for r in index.resolve(rows).collect()), index, rows


@pytest.mark.parametrize("hot", [100_000, 3])
def test_dedup_is_brute_force(spark, awkward, monkeypatch, hot):
    monkeypatch.setattr(dedupindex, "HOT_PART", hot)
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a b", "a  b", "a\n\nb", " a b", "ab", "", None, "c" * rnd.randrange(4)]), "en", "s", 1) for i in rnd.sample(range(900), 300)]
    for part in (rows, AWKWARD):
        assert resolved(spark, spark.createDataFrame(part, COLUMNS))[0] == kept_by_hand(part)


def test_batches_are_held_against_the_index(spark):
    """A later batch keeps what the earlier one published, a batch that comes twice changes nothing, and the index outlives its object."""
    index = fresh(spark)
    one = dedupindex.digests(spark.createDataFrame([(5, "x"), (6, "y"), (7, "x")], "doc_id bigint, text string"))
    two = dedupindex.digests(spark.createDataFrame([(1, "x"), (2, "z"), (3, "z ")], "doc_id bigint, text string"))
    index.add(one)
    again = dedupindex.DigestIndex(spark, index.path, 99)
    assert again.buckets == 8
    again.add(two)
    again.add(two)
    index.add(one)
    assert sorted(r.keep_id for r in index.rows().collect()) == [2, 3, 5, 6]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.resolve(two).collect()) == [(1, 5, False), (2, 2, True), (3, 3, True)]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.resolve(one).collect()) == [(5, 5, True), (6, 6, True), (7, 5, False)]
    small = again.compact(f"{index.path}-compact")
    assert sorted(map(tuple, small.rows().collect())) == sorted(map(tuple, index.rows().collect()))


def test_index_is_merged_without_a_shuffle(spark):
    """Only the digests of the batch move; the index side of the anti-join is read as it is stored."""
    _, index, rows = resolved(spark, spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id bigint, text string"))
    plan = index.new(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    index_side = plan[plan.index("Exchange hashpartitioning") + 1 :]
    assert "Exchange" not in index_side and "Bucketed: true" in index_side


def test_dedup_of_an_empty_table_and_clashing_columns(spark, awkward):
    empty = spark.createDataFrame([], COLUMNS)
    assert not resolved(spark, empty)[0]
    clash = awkward.selectExpr("*", "'x' AS digest", "1 AS at", "2 AS keep_id", "3 AS kept")
    assert resolved(spark, clash)[0] == kept_by_hand(AWKWARD)


# -- 12

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features_by_hand(text, n, buckets):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


@settings(max_examples=100, deadline=None)
@given(texts=some.lists(some.one_of(some.none(), some.text(alphabet=some.one_of(some.sampled_from("aB c9\x00.É語 "), some.characters(blacklist_categories=["Cs"])), max_size=30)), min_size=1, max_size=6), n=some.integers(1, 3))
def test_features_never_cross_documents(texts, n):
    docs, at, words = resampling.features([None if t is None else t.encode() for t in texts], n, 1000)
    for i, t in enumerate(texts):
        want, many = features_by_hand(t, n, 1000)
        assert Counter(at[docs == i].tolist()) == Counter(want) and words[i] == many


def drawn_by_hand(rows, target, n, buckets, percent, least):
    raw, goal = Counter(), Counter()
    own = [features_by_hand(t, n, buckets) for _, t in rows]
    for f, _ in own:
        raw.update(f)
    for t in target:
        goal.update(features_by_hand(t, n, buckets)[0])
    all_s, all_t = sum(raw.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (all_s + buckets) / ((raw[b] + 1) * (all_t + buckets)))) for b in raw}
    out = []
    for (i, _), (f, many) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), many))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    taken = Counter()
    for place, r in enumerate(able[: len(able) * percent // 100]):
        taken[(*r[:4], place + 1)] += 1
    for r in able[len(able) * percent // 100 :] + [r for r in out if r[4] < least]:
        taken[(*r[:4], None)] += 1
    return taken


@pytest.mark.parametrize(("n", "percent", "ranges"), [(1, 30, 1_000_000), (2, 100, 10)])
def test_resampling_is_brute_force(spark, monkeypatch, n, percent, ranges):
    monkeypatch.setattr(resampling, "RANGE_ROWS", ranges)
    rnd = random.Random(5)
    rows = [(i // 2, " ".join(rnd.choice(["red", "Blue", "green-ish", "ß9", "x"]) for _ in range(rnd.randrange(12)))) for i in range(160)]
    rows += [(None, "red blue red"), (3, None), (4, "")]
    target = ["blue blue red", None, "9"]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string"), n, 50, percent, 3)
    assert Counter(map(tuple, got.collect())) == drawn_by_hand(rows, target, n, 50, percent, 3)


def test_resampling_awkward(spark, awkward):
    target = spark.createDataFrame([], "item_id bigint, text string")
    clash = awkward.selectExpr("*", "1 AS score", "'x' AS rank", "2 AS at", "3 AS n")
    got = Counter(map(tuple, resampling.resample(clash, target, least_words=2, percent=50).collect()))
    assert got == drawn_by_hand([(r[0], r[1]) for r in AWKWARD], [], 1, 10_000, 50, 2)
    assert resampling.resample(spark.createDataFrame([], COLUMNS), target).collect() == []


# -- 13

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audited_by_hand(rows, least, top):
    counts, docs, groups = {}, {}, {}
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
        groups.setdefault(lang, set()).add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept))

        for s in sources:
            own = counts[lang, s]
            pairs = sorted(((-sum(abs(p(own, t) - p(counts[lang, o], t)) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((p(total, t) - p(own, t), t.encode()) for t in kept if own[t] and p(own, t) > p(total, t))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("block", "width"), [(64, 2048), (2, 3)])
def test_audit_is_brute_force(spark, monkeypatch, block, width):
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", block)
    monkeypatch.setattr(divergence, "RANGE_TERMS", width)
    rnd = random.Random(7)
    words = ["Ab", "ab", "c", "dé", "é", "語", "x1y", "zz", "q", "rr"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randrange(1, 11)]) for _ in range(rnd.randrange(9))), rnd.choice(["en", "fr", None]), f"s{rnd.randrange(7)}", 0) for i in range(200)]
    rows += [(0, None, "en", "empty", 0), (0, "12", "none", "a", 0), (0, "", "none", "b", 0), *AWKWARD]
    got = divergence.audit(spark.createDataFrame(rows, COLUMNS), 4, 3)
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    assert sorted(map(tuple, got.collect())) == audited_by_hand(rows, 4, 3)


def test_audit_awkward(spark, awkward):
    assert divergence.audit(spark.createDataFrame([], COLUMNS)).collect() == []
    clash = awkward.selectExpr("*", "1 AS term", "'x' AS part", "2 AS docs", "3 AS place")
    assert sorted(map(tuple, divergence.audit(clash, 1, 5).collect())) == audited_by_hand(AWKWARD, 1, 5)


def test_trees_share_nodes_and_are_exact():
    rnd = np.random.default_rng(1)
    counts = rnd.integers(0, 3, (6, 64)) * (rnd.random((6, 64)) < 0.2)
    counts[:, 60:] = -1
    trees = divergence.Trees(counts)
    nodes = len(trees.leaves) + sum(len(a) for a, _ in trees.levels)
    assert nodes < 6 * 127 / 2
    for a in range(6):
        for b in range(6):
            for wholes in ((700, 900), (10**15, 10**15 + 1)):
                want = sum(abs(10**9 * (int(x) + 5) // wholes[0] - 10**9 * (int(y) + 5) // wholes[1]) for x, y in zip(counts[a], counts[b], strict=True) if x >= 0)
                assert trees.apart(a, b, *wholes) == want


def test_shares_of_large_counts():
    n = np.array([10**12, 0, -1])
    assert divergence.shares(n, 3 * 10**12).tolist() == [1 + 10**9 * (10**12 + 5) // (3 * 10**12), 1 + 5 * 10**9 // (3 * 10**12), 0]


def test_what_a_task_gathers_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "GATHERED", 3)
    take, finish = divergence.counter()
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a"], "source": ["s", "t"], "text": ["b c b", "b d"]})
    rows = [r for out in [*take(batch), *take(batch.slice(0, 1)), *finish()] for r in out.to_pylist()]
    total = Counter()
    for r in rows:
        assert set(r["docs"]) == {1}
        for term, n in zip(r["terms"], r["n"], strict=True):
            total[r["source"], term] += n
    assert len(rows) == 3 and total == Counter({("s", "b"): 4, ("s", "c"): 2, ("t", "b"): 1, ("t", "d"): 1})
