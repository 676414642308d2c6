"""What the join of near copies leaves on disk, and that its n-grams are counted right slice by slice."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from strokemill.llm import jaccardjoin
from strokemill.llm.common import shared_dir


def held_by(folders) -> dict:
    """Bytes of each file below the folders."""
    found = {}
    for top in folders:
        for folder, _, names in os.walk(top):
            for name in names:
                try:
                    found[f"{folder}/{name}"] = os.lstat(f"{folder}/{name}").st_size
                except OSError:  # Spark deletes shuffle files meanwhile
                    pass
    return found


def test_disk_of_the_join(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(0, 600, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(1000)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(["other", *words[1:]]))]
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shared = shared_dir(spark).removeprefix("file://")
    folders = [*(x.getPath() for x in blocks), shared]
    before, tops, real = held_by(folders), [], jaccardjoin.materialize

    def watched(df, name):
        out = real(df, name)
        tops.append((sum(size for file, size in held_by(folders).items() if file not in before), name))
        return out

    monkeypatch.setattr(jaccardjoin, "materialize", watched)
    out = jaccardjoin.join_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert {i: c for i, (_, c) in got.items()} == {i: i - i % 2 for i in range(600)}
    ngrams = 8 * sum(n for n, _ in got.values())
    assert max(tops)[0] < 2.6 * ngrams, (max(tops), ngrams)
    # the keys of all documents and the whole sets are not kept; what the result reads is
    new = {os.path.relpath(file, shared).split("/")[0].rsplit("-", 1)[0] for file in held_by([shared]) if file not in before}
    assert "classes" in new and not new & {"sketches", "suspect-sets"}
    assert out.count() == 600


def test_unshared_counts_the_ngrams_of_one_class(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    sets = {c: np.unique(rng.choice(pool, rng.integers(1, 200))) for c in range(40)}
    often = Counter(int(x) for s in sets.values() for x in s)
    at = {c: (s >> np.uint64(61)).astype(int) for c, s in sets.items()}
    rows = [(c, *([int(x) for x in s[at[c] == p].view(np.int64)] for p in range(jaccardjoin.COUNTED))) for c, s in sets.items()]
    table = spark.createDataFrame(rows, "class bigint, " + ", ".join(f"{p} array<bigint>" for p in jaccardjoin.PARTS))
    want = {c: n for c, s in sets.items() if (n := sum(often[int(x)] == 1 for x in s))}
    assert {r["class"]: r.alone for r in jaccardjoin.unshared(table).collect()} == want


def test_parts_of_a_set_are_its_ngrams():
    texts = ["", "one", " ".join(f"w{i % 70}x{i}" for i in range(500)), None]
    sets = [jaccardjoin.shingles(t) for t in texts]
    batch = pa.RecordBatch.from_pydict({"class": [jaccardjoin.digest(s) for s in sets], "_t": [1, 2, 3, 4], "text": texts})
    got = jaccardjoin.unfolder(3)(batch).to_pylist()
    for row, s in zip(got, sets, strict=True):
        parts = [np.array(row[p], np.int64).view(np.uint64) for p in jaccardjoin.PARTS]
        assert np.concatenate(parts).tolist() == s.tolist()
        assert all((x >> np.uint64(61) == p).all() for p, x in enumerate(parts))
