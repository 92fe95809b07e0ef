"""Operators of the core on edge cases and against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import text as T
from quernel.operators import dedup, filters, select, similarity


def col(spark, values, expression):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(expression(F.col("t")).alias("x")).collect()]


def test_content_key(spark):
    assert col(spark, ["A  B", "a b", "ü", "STRASSE", "Straße", "İ", None], T.content_key) == ["a b", "a b", "ü", "strasse", "strasse", "i̇", ""]


def test_lines(spark):
    assert col(spark, ["a\r\nb\x0bc d\n", "", "\n"], T.lines) == [["a", "b", "c", "d"], [""], [""]]


def test_shingles(spark):
    assert col(spark, ["a b c", "a b c d e f", ""], lambda c: T.shingles(T.words(c), 5)) == [["a b c"], ["a b c d e", "b c d e f"], []]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("x" * 119, "too_short"),
        (None, "too_short"),
        ("the and of " * 11, None),
        ("ok �", "replacement_character"),
        ("a\x00b", "control_character"),
        ("\ta " * 60, None),  # no known word, all ASCII: en with just enough confidence
        ("the " * 40 + "a" + "b" * 39, None),
        ("the " * 40 + "a" * 40, "repeated_character"),
        ("the very same line over and over again\n" * 3 + "the second line of it\n" * 1 + "the third line of it", "repeated_lines"),
        ("mail someone@site.org " + "the and of " * 15, "material_pii_email"),
        ("mail someone@example.com " + "the and of " * 15, None),
        ("the host 10.0.0.1 " + "the and of " * 15, None),
        ("{{x}} " + "the and of " * 15, "markup_leakage"),
        ("ve bir bu " * 20, "wrong_or_uncertain_language"),
    ],
)
def test_quality_reason(spark, text, reason):
    df = spark.createDataFrame([(1, text, "en", "x")], "id int, text string, lang string, _c string").select("id", "text", "lang")
    assert [r.reason for r in filters.with_quality_reason(df).collect()] == [reason]


def test_first_by_key(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (5, None), (4, None)], "id int, k string")
    got = {r.id: r.representative_id for r in dedup.first_by_key(df, "k", ["id"], "id").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def test_line_duplicates(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(1, f"{line}\nshort\nshort"), (2, f"```\n{line}\n```\n{line}"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r.doc_id, r.lineno): r.keep for r in dedup.line_duplicates(df).collect()}
    assert got[1, 0] and got[1, 2] and got[2, 1] and not got[2, 3] and (3, 0) not in got


def test_greedy_is_the_ordered_pass(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    got = {r.id: (r.kept, r.representative_id) for r in dedup.greedy(spark.createDataFrame(edges, "a long, b long")).collect()}
    kept: set[int] = set()
    for n in sorted({x for e in edges for x in e}):
        hit = [a for a, b in edges if b == n and a in kept]
        if not hit:
            kept.add(n)
        assert got[n] == (not hit, min(hit) if hit else n)


def test_greedy_in_rounds_and_along_chains(spark):
    rng = random.Random(7)
    edges = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(900)})
    df = spark.createDataFrame(edges, "a long, b long")
    rounds = {(r.id, r.kept, r.representative_id) for r in dedup.greedy(df, fold_edges=5).collect()}
    assert rounds == {(r.id, r.kept, r.representative_id) for r in dedup.greedy(df).collect()}
    chain = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    assert {r.id for r in dedup.greedy(chain).where("kept").collect()} == set(range(0, 1001, 2))


def test_ten_thousand_copies(spark):
    text = "one notice of ten words that all of these hold " * 3
    df = spark.range(10_000).selectExpr("id AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(20_000, text + "more")], "doc_id long, text string"))
    links = similarity.jaccard_links(df, threshold=0.6)
    rows = links.collect()
    assert len(rows) == 10_000 and {(r.kind, r.a) for r in rows} == {("copy", 0), ("link", 0)}
    done = {r.id: (r.kept, r.representative_id) for r in dedup.greedy_links(links).collect()}
    assert done[0] == (True, 0) and done[20_000] == (False, 0) and done[9_999] == (False, 0) and len(done) == 10_001


def test_simhash_takes_the_projects_hash(spark):
    import hashlib

    words = "one two three four five six seven".split()
    votes = [0] * 64
    for i in range(3):
        h = int.from_bytes(hashlib.blake2b(" ".join(words[i : i + 5]).encode(), digest_size=8).digest(), "big")
        for bit in range(64):
            votes[bit] += 1 if h >> bit & 1 else -1
    want = sum(1 << bit for bit in range(64) if votes[bit] >= 0)
    got = similarity.simhash(spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string")).collect()
    assert {r.id: r.h & (2**64 - 1) for r in got} == {1: want, 2: 0, 3: 0}


def test_greedy_without_edges(spark):
    assert dedup.greedy(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts, k, threshold):
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(similarity.TOKENS, (t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_jaccard_pairs_misses_none(spark, threshold):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    texts = {}
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    texts |= {60: None, 61: "", 62: "w1", 63: "w1", 64: "!!"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = similarity.jaccard_links(df, threshold=threshold).collect()
    classes = {}
    for r in rows:
        if r.kind == "copy":
            classes.setdefault(r.a, {r.a}).add(r.b)
    got = {p for c in classes.values() for p in itertools.combinations(sorted(c), 2)}
    got |= {tuple(sorted((x, y))) for r in rows if r.kind == "link" for x in classes.get(r.a, {r.a}) for y in classes.get(r.b, {r.b})}
    assert got == brute(texts, 5, threshold) | set(itertools.combinations((60, 61, 64), 2))


def test_simhash_pairs_misses_none(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) for _ in range(20)]
    for h in hashes[:10]:
        for _ in range(3):
            g = h
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                g ^= 1 << bit
            hashes.append(g)
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    got = {(r.a, r.b): r.distance for r in similarity.simhash_pairs(spark.createDataFrame(rows, "id long, h long")).collect()}
    want = {(a, b): (hashes[a] ^ hashes[b]).bit_count() for a, b in itertools.combinations(range(len(hashes)), 2) if (hashes[a] ^ hashes[b]).bit_count() <= 3}
    same = {k for k, v in want.items() if v == 0}
    # equal hashes are reported through the first of them
    assert all(want[k] == v for k, v in got.items()) and {k for k in want if hashes.index(hashes[k[0]]) == k[0] and hashes.index(hashes[k[1]]) == k[1]} | {k for k in same if hashes.index(hashes[k[1]]) == k[0]} <= set(got)


def test_budget(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 9, 4, 2, 3, None])], "source string, doc_id long, n_tokens long")
    assert sorted((r.doc_id, r.running) for r in select.budget(df, 10, 11).collect()) == [(0, 5), (2, 9), (3, 11)]


def test_pack(spark):
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate([10, 11, 4, 6, 1])], "split string, doc_id long, n_tokens long")
    packed = select.pack(df, 10)
    assert sorted((r.doc_id, r.shard, r.start_offset, r.end_offset) for r in packed.collect()) == [(0, 0, 0, 10), (2, 1, 0, 4), (3, 1, 4, 10), (4, 2, 0, 1)]
    assert select.gaps(packed, ["split", "shard"]).count() == 0


def test_pack_keeps_longer_documents(spark, tmp_path):
    from quernel.plans import catalogue
    from quernel.sources import sinks

    df = spark.createDataFrame([("t", i, n) for i, n in enumerate([11, 10, 4, 25, 6, 1])], "split string, doc_id long, n_tokens long")
    packed = select.pack(df, 10, oversize="own")
    assert sorted((r.doc_id, r.shard, r.start_offset, r.end_offset) for r in packed.collect()) == [(0, 0, 0, 11), (1, 1, 0, 10), (2, 2, 0, 4), (3, 3, 0, 25), (4, 4, 0, 6), (5, 4, 6, 7)]
    assert select.gaps(packed, ["split", "shard"]).count() == 0
    with pytest.raises(ValueError, match="2 documents"):
        select.pack(df, 10, oversize="raise")
    tokens = spark.createDataFrame([("t", 1, [1, 2, 3]), ("t", 2, [4] * 11)], "split string, doc_id long, token_ids array<int>")
    with pytest.raises(ValueError, match="1 documents"):
        sinks.token_shards(tokens, str(tmp_path / "shards"), 10)
    assert not (tmp_path / "shards").exists()
    spark.createDataFrame([(i, n) for i, n in enumerate([400, 60_000, 500])], "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id, r.end_offset - r.start_offset) for r in catalogue.queries()["pack_next_fit"](spark, str(tmp_path)).collect()) == [(0, 400), (1, 60_000), (2, 500)]
    assert catalogue.queries()["boundary_check"](spark, str(tmp_path)).count() == 0


def test_running_doesnt_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    want = 0
    expected = {}
    for i in range(1000):
        expected[i] = want
        want += i % 7
    for parts in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        assert {r.id: r.s for r in select.running(df, [F.col("id")], F.col("v"), "s").collect()} == expected
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_window_overlap(spark):
    df = spark.createDataFrame([("a", 0, 700), ("b", 700, 1024), ("c", 1024, 1024)], "source string, start_offset long, end_offset long")
    over = select.window_overlap(df, 512, ["source"])
    assert sorted(map(tuple, over.collect())) == [(0, "a", 512), (1, "a", 188), (1, "b", 324)]
    assert sorted(map(tuple, select.dominant(over, "source").collect())) == [(0, "a"), (1, "b")]


def test_longest_runs(spark):
    df = spark.createDataFrame(list(enumerate("aabbbacc")), "i long, v string")
    assert {r.v: r.run for r in select.longest_runs(df, "i", "v").collect()} == {"a": 2, "b": 3, "c": 2}


def test_stream_resumes(spark, tmp_path):
    from quernel.streaming.resume import deduplicated_stream

    data = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "A "), (3, "b")], "doc_id long, text string").write.parquet(str(data / "documents.parquet"))
    root = str(tmp_path / "state")
    assert deduplicated_stream(spark, str(data), root=root).count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").write.mode("append").parquet(str(data / "documents.parquet"))
    assert deduplicated_stream(spark, str(data), root=root).count() == 3


def test_containing(spark):
    docs = spark.createDataFrame([(1, "abcd xyz"), (2, "bcd"), (3, None), (4, "")], "doc_id long, text string")
    snippets = spark.createDataFrame([("bcd",), ("xyz",), ("no",), ("",), (None,), ("bcd",)], "snippet string")
    for block in (1, 100):
        assert {tuple(r) for r in similarity.containing(docs, snippets, block=block).collect()} == {("bcd", 1), ("bcd", 2), ("xyz", 1)}
    assert similarity.containing(docs, snippets.limit(0)).count() == 0


def test_simhash_match_counts_send_nothing_through_the_driver(spark):
    """the tables of hashes were joined by broadcast, and each computed twice."""
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(20)]
    near = lambda h: h ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 4)))
    left = spark.createDataFrame([(i, near(rng.choice(base))) for i in range(100)] + [(100, 0), (101, 0), (3, 0)], "id long, h long")
    right = spark.createDataFrame([(i, near(rng.choice(base))) for i in range(150)] + [(i, 0) for i in range(200, 230)], "id long, h long")
    got = similarity.simhash_match_counts(left, right)
    want = {}
    for a, x in left.collect():
        for _, y in right.collect():
            if (x ^ y).bit_count() <= 3:
                want[a] = want.get(a, 0) + 1
    assert {r.a: r.matches for r in got.collect()} == want and want[100] == 30
    assert {r.a: r["count"] for r in similarity.simhash_matches(left, right).groupBy("a").count().collect()} == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
