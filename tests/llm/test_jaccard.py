import random

from pyspark.sql import functions as F

from tests.llm.docs import documents
from tests.llm.test_simhash_and_ann import near_copies
from tracewell.llm import jaccard


def sets_by_hand(t):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return tuple(words), {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    """The smallest doc_id of each group, every pair compared."""
    made = [sets_by_hand(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (w, s) in enumerate(made):
        for j, (v, t) in enumerate(made[:i]):
            if w == v or (s | t and 5 * len(s & t) >= 4 * len(s | t)):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(str(min((k for k in keys if k is not None), default=None)) for keys in groups.values())


def edited():
    """Copies with a few words changed, at similarities around 0.8, in chains, and a passage that many share."""
    rng, rows, key = random.Random(3), [], 1000
    passage = [f"p{k}" for k in range(30)]
    for family in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for k in range(10):
            if k % 5 == 0:
                words = list(words)
            copy = list(words)
            for _ in range(k % 4):
                copy[rng.randrange(60)] = f"x{rng.randrange(9999)}"
            words = copy if k > 6 else words
            rows.append((key := key + 1, " ".join(copy).upper() if k == 2 else " ".join(copy), "en", "s", 1))
    for _ in range(30):
        rows.append((key := key + 1, " ".join([*passage, *(f"y{rng.randrange(9999)}" for _ in range(30))]), "en", "s", 1))
    return rows


def kept(df):
    return sorted(str(r.doc_id) for r in jaccard.keep_first(df).select("doc_id").collect())


def test_groups_against_brute_force(spark):
    rows = near_copies() + edited()
    df = documents(spark, rows)
    assert jaccard.keep_first(df).columns == df.columns
    want = by_hand(rows)
    assert kept(df) == want
    roots = jaccard.grouped(df, part=3).select("root").distinct().count()
    assert roots == len(want)


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    copies = [(k, " ".join("changed" if k and i in (30 * k, 100 + 9 * k, 195 - k) else w for i, w in enumerate(words)), "en", "s", 1) for k in range(3)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert [r.doc_id for r in stage(spark, documents(spark, copies), "").collect()] == [0]


def test_empty_table(spark):
    assert jaccard.keep_first(documents(spark, []).withColumn("more", F.lit(1))).count() == 0


def test_repeated_doc_ids_lose_no_group(spark):
    import corpus_pipeline

    x, y = (" ".join(f"{c}{k}" for k in range(80)) for c in "xy")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    df = documents(spark, [(k, t, "en", "s", 1) for k, t in ((3, x), (5, x), (5, y), (None, y))])
    assert sorted((r.doc_id, r.text) for r in stage(spark, df, "").collect()) == [(3, x), (5, y)]


def test_pairs_are_made_at_their_first_shared_value(spark):
    """40 nodes that share 3 in 4 of 100 values: a pair shares about 56, and is made about once, also in parts."""
    rng = random.Random(4)
    rows = [(v, node, node) for node in range(40) for v in range(100) if rng.random() < 0.75]
    mixed = spark.createDataFrame(rows, "v long, node long, root long").withColumn("count", F.count("*").over(jaccard.Window.partitionBy("v")))
    points = spark.createDataFrame([(k, 500, *[0] * len(jaccard._POINT)) for k in range(40)], ", ".join(["node long", "n int", *(f"{o} long" for o in jaccard._POINT)]))
    for part in (1000, 7):
        made = [tuple(r) for r in jaccard._made(mixed, points, part).collect()]
        assert set(made) == {(a, b) for a in range(40) for b in range(a + 1, 40)}
        assert len(made) < 1.5 * len(set(made))


def test_large_sets_of_finer_points_of_two_sizes(spark):
    """Linked and unlinked sets on either side of a size from which the finer points double."""
    words = [f"w{k}" for k in range(1035)]
    rows = [(1, words[:1020]), (2, words), (3, ["a" if k % 20 == 0 else w for k, w in enumerate(words)]), (4, [f"v{w}" if k > 700 else w for k, w in enumerate(words)])]
    sizes = [len(jaccard._fine(jaccard.shingles(jaccard.words_of(" ".join(w))))) for _, w in rows]
    assert sizes[0] * 2 == sizes[1]
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in rows]
    assert kept(documents(spark, rows)) == by_hand(rows) == ["1", "3", "4"]
