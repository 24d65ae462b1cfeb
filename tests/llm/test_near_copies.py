"""Near copies of the pipeline against brute-force Jaccard."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from palimpsest.llm import near_copies
from palimpsest.llm.near_copies import SEARCH, WORDS, drop_similar, keys, shingles, similar
from palimpsest.llm.simhash import majority

SCHEMA = "doc_id long, text string"


def kept(rows):
    """Smallest ids of the components of brute-force pairs at 0.8 or more."""
    sets = [set(shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(rng, words, edits):
    out = list(words)
    for i in rng.choice(len(out), edits, replace=False):
        out[i] = f"x{rng.integers(1 << 30)}"
    return " ".join(out)


def test_covering_masks_hold_the_radius():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 63, (400, WORDS), dtype=np.uint64)
    y = x.copy()
    for row in y:
        for place in rng.choice(64 * SEARCH, 23, replace=False):
            row[place // 64] ^= np.uint64(1) << np.uint64(place % 64)
    assert (keys(x) == keys(y)).any(1).all()
    assert (keys(x) == keys(x[::-1])).sum() <= 40


def test_recall_against_brute_force(spark):
    """Pairs of similarity 0.8 to 0.85, the hardest ones, each in a group of its own: at least nine of ten are found."""
    rng, rows, pairs = np.random.default_rng(4), [], 0
    for group in range(200):
        words = [f"g{group}w{i}" for i in range(300)]
        rows += [(2 * group, " ".join(words)), (2 * group + 1, edited(rng, words, 6))]
        x, y = (shingles(t) for _, t in rows[-2:])
        assert similar(x, y)
        pairs += 1
    left = drop_similar(spark.createDataFrame(rows, SCHEMA).repartition(4)).count()
    assert left <= 2 * pairs - 0.95 * pairs


def mostly(got, rows):
    """Nothing but what brute force drops is dropped (a missed link may leave another of a group), and 0.95 of that."""
    want = set(kept(rows))
    print(len(rows), len(want), len(got))
    assert want <= got and len(got) - len(want) <= 0.05 * (len(rows) - len(want))


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_as_exact_jaccard(spark, tile):
    rng, rows = np.random.default_rng(3), [(0, None), (1, ""), (2, "one two"), (3, "ONE  two")]
    for group in range(60):
        words = [f"g{group}w{i}" for i in range(120)]
        rows += [(len(rows) + n, edited(rng, words, int(rng.integers(0, 3)))) for n in range(4)]
    words = [f"d{i}" for i in range(200)]
    rows += [(len(rows) + n, edited(rng, words, 3)) for n in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    mostly({r.doc_id for r in drop_similar(docs, tile=tile).collect()}, rows)


def test_large_buckets(spark, monkeypatch):
    """Buckets that come in parts."""
    monkeypatch.setattr(near_copies, "BUCKET", 16)
    rng = np.random.default_rng(6)
    words = [f"d{i}" for i in range(300)]
    rows = [(n, edited(rng, words, 2)) for n in range(200)]
    value = np.array([majority(shingles(t), WORDS) for _, t in rows])
    cols = [keys(value).ravel(), *(np.repeat(c, 90) for c in (value[:, 0], value[:, 1], np.arange(200, dtype=np.uint64)))]
    order = np.lexsort((cols[1], cols[0]))
    batch = [pa.RecordBatch.from_arrays([pa.array(c[order[i : i + 50]].view(np.int64)) for c in cols], names=["key", "first", "second", "node"]) for i in range(0, len(order), 50)]
    found = pa.Table.from_batches(list(near_copies._first(iter(batch)))).to_pydict()
    sizes = np.unique(cols[0], return_counts=True)[1]
    assert len(found["key"]) >= sizes[sizes > 66].sum() > 0
    assert len({*found["node"]}) == 200
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == kept(rows)


def test_rows_not_ids_are_dropped(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t, 1), (9, t + " end", 2), (9, "quite another text of its own", 3), (5, t, 4), (None, t, 5), (None, "alone here", 6), (None, "alone here", 7), (7, None, 8), (8, "", 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", node int")
    out = drop_similar(df.withColumn("value", df["node"]))
    assert out.columns == ["doc_id", "text", "node", "value"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(5, t), (9, "quite another text of its own"), (None, "alone here"), (7, None)], key=repr)
    assert drop_similar(df.limit(0)).count() == 0


def test_pipeline_stage_against_brute_force(spark):
    """On the table nearly all that brute force drops goes, and nothing else does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mostly({r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}, sorted(map(tuple, docs.collect())))


def test_similar_at_the_border():
    x = np.arange(10, dtype=np.uint64)
    assert similar(x[:9], x[1:]) and not similar(x[:8], x[1:9]) and similar(x[:0], x[:0])


def test_a_pair_is_made_once():
    """Of a dense group each candidate pair comes from one bucket and one tile, and none is left out."""
    rng = np.random.default_rng(8)
    words = [f"d{i}" for i in range(300)]
    sets = [shingles(edited(rng, words, 2)) for _ in range(60)]
    value = np.array([majority(x, WORDS) for x in sets])
    own = keys(value).view(np.int64)
    listed = [[k for k in row.tolist() if rng.random() < 0.7] for row in own]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(listed, pa.list_(pa.int64())), pa.array([v.tobytes() for v in value], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["node", "keys", "value", "size"])
    told = next(near_copies._told(iter([batch]))).column(2).to_pylist()
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if {*listed[i]} & {*listed[j]} and np.bitwise_count(value[i] ^ value[j]).sum() <= near_copies.ALL_BITS}
    for blocks in (1, 3):
        rows = sorted((k, min(i % blocks, o) * blocks + max(i % blocks, o), -1 if i % blocks == o else i % blocks, i) for i in range(60) for k in listed[i] for o in range(blocks))
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), *[pa.array([r[3] for r in rows], pa.int64())] * 2, pa.array([told[r[3]] for r in rows], pa.binary())]
        table = pa.Table.from_batches(list(near_copies._cross(0)(iter(pa.table(cols, names=["key", "tile", "block", "node", "root", "value"]).to_batches(500)))))
        got = [frozenset(p) for p in zip(*(table[c].to_pylist() for c in ("a", "b")), strict=True)]
        assert len(got) == len({*got}) and {*got} == want and len(want) > 500
