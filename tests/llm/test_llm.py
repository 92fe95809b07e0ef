"""Operators for training text: edge cases, brute force, round trips."""

import datetime
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import language, leakage, mixing, mojibake, neardup, pairs, pii, queries, spam, tokens
from quernel.llm.text import Cache, fold

T0 = datetime.datetime(2024, 1, 1)
PIECES = ["▁", "▁a", "▁ab", "abc", "b", "c", "bc", "▁the", "re", "▁r", "e"]


def pieces(spark):
    return spark.createDataFrame([(i, p, "normal") for i, p in enumerate(PIECES)] + [(90, "</s>", "control"), (91, "<0x41>", "byte"), (92, None, "normal")], "piece_id int, piece string, kind string")


def greedy_tokens(text):
    n = 0
    for word in re.split("[ \t\r\n]+", text):
        if not word:
            continue
        word, i = "▁" + word, 0
        while i < len(word):
            fit = [p for p in PIECES if word.startswith(p, i)]
            if fit:
                i += max(map(len, fit))
                n += 1
            else:
                n += len(word[i].encode())
                i += 1
    return n + 1


# --- 2: tokens


def test_piece_counter_is_longest_match():
    counter = tokens.PieceCounter(frozenset(PIECES))
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abcreth \n\t\r é😀▁\xa0") for _ in range(rng.randint(0, 30)))
        assert counter.text(text) == greedy_tokens(text)
    assert counter.text(None) is None and counter.text("") == 1 and counter.text("ab" * 100_000) > 1


def test_count_tokens_keeps_columns(spark):
    df = spark.createDataFrame([(1, "abc", T0, ["x"]), (2, None, None, None)], "doc_id long, text string, at timestamp, tags array<string>")
    out = tokens.count_tokens(df, pieces(spark))
    assert out.columns == ["doc_id", "at", "tags", "n_tokens"] and {r.doc_id: r.n_tokens for r in out.collect()} == {1: greedy_tokens("abc"), 2: None}
    with pytest.raises(ValueError):
        tokens.count_tokens(out.withColumn("text", F.lit("a")), pieces(spark))
    assert tokens.count_tokens(df.limit(0), pieces(spark)).count() == 0


def test_stale_counts(spark):
    true = greedy_tokens("abc ab " * 20)
    rows = [(1, true), (2, None), (3, true * 2), (4, int(true * 1.05)), (5, int(true * 1.05) + 2), (5, int(true * 1.05) + 2)]
    df = spark.createDataFrame([(i, n, "abc ab " * 20) for i, n in rows] + [(6, 3, None), (7, None, None)], "doc_id long, token_count int, text string")
    assert sorted(r.doc_id for r in tokens.stale_counts(df, pieces(spark)).collect()) == [2, 3, 5, 7]


def test_token_totals(spark):
    docs = spark.createDataFrame([(1, 7.0, "s", "tr", "c", "ab"), (2, None, "s", None, None, "ab"), (3, 9.0, None, "en", "c", None)], "doc_id long, ext_id double, source string, lang string, category string, text string")
    ext = spark.createDataFrame([(7, "x", "tr", None, T0), (7, "y", "en", "k", T0 + datetime.timedelta(1))], "ext_id long, source_id string, language string, category string, loaded_at timestamp")
    got = {(r.level, r.source, r.lang, r.category): (r.docs, r.tokens) for r in tokens.token_totals(docs, ext, pieces(spark)).collect()}
    two = greedy_tokens("ab")
    assert got["slice", "y", "en", "k"] == (1, two) and got["slice", "s", None, None] == (1, two) and got["all", None, None, None] == (3, 2 * two) and got["source", None, None, None] == (1, None)


# --- 8: mixing


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing._permute(np.arange(n), n, 5).tolist()) == list(range(n))


def mix_input(spark):
    docs = spark.createDataFrame([(i, "big" if i % 4 else "small", "ab " * (5 + i % 7)) for i in range(200)] + [(900, None, "ab " * 40), (901, "big", None), (902, "big", "")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.5), ("m", "small", 0.5, 2, 0.5), ("m", "none", 0.1, 9, 0.5), (None, "big", 1.0, 1, 1.0)], "mix_id string, source string, target_share double, max_repeats int, budget_ratio double")
    return docs, targets


def test_mix_respects_repeats_and_blocks(spark):
    docs, targets = mix_input(spark)
    sized = tokens.count_tokens(docs, pieces(spark)).where("n_tokens is not null")
    packed = mixing.pack_blocks(sized, 16).collect()
    per_doc = {}
    for r in packed:
        assert 0 <= r.from_token < r.to_token and r.to_token - r.from_token <= 16
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.to_token - r.from_token
    assert per_doc == {r.doc_id: r.n_tokens for r in sized.collect() if r.source}
    slots = mixing.mix_slots(sized, targets, block=16, shards=4).collect()
    for source, limit in (("big", 1), ("small", 2)):
        own = [(r.repeat, r.block_index) for r in slots if r.source == source]
        assert len(own) == len(set(own)) and max(r for r, _ in own) < limit
    again = mixing.mix_slots(sized, targets, block=16, shards=4).collect()
    assert sorted(map(tuple, slots)) == sorted(map(tuple, again))
    shares = {r.source: r for r in mixing.mix_shares(docs, pieces(spark), targets, block=16, shards=4).collect()}
    assert shares["none"].tokens == 0 and abs(sum(r.share for r in shares.values()) - 1) < 1e-9 and shares["small"].most_repeats <= 2


def test_unreachable(spark):
    docs, targets = mix_input(spark)
    n = {}
    for r in docs.collect():
        n[r.source] = n.get(r.source, 0) + (greedy_tokens(r.text) if r.text is not None else 0)
    total = sum(n.values())
    want = {(r.mix_id, r.source) for r in targets.collect() if n.get(r.source, 0) * r.max_repeats < r.target_share * r.budget_ratio * total}
    assert {(r.mix_id, r.source) for r in mixing.unreachable(docs, pieces(spark), targets).collect()} == want


def test_shard_counts_agree_in_every_task():
    counts = np.array([1000, 37, 0, 5003], np.int64)
    whole, ahead = mixing.shard_counts(counts, 50, 0, 50, [3])
    assert whole.sum(0).tolist() == counts.tolist() and not ahead.any() and set(whole.sum(1).tolist()) <= {120, 121}
    for low in (0, 16, 32, 48):
        part, ahead = mixing.shard_counts(counts, 50, low, min(50, low + 16), [3])
        assert (part == whole[low : low + 16]).all() and (ahead == whole[:low].sum(0)).all()
    huge = np.array([3 * 10**10, 5, 10**10], np.int64)
    part, _ = mixing.shard_counts(huge, 1_000_000, 999_990, 1_000_000, [3])
    assert part.sum() == 10 * (int(huge.sum()) // 1_000_000)


# --- 4: near duplicates


def jaccard_truth(texts, threshold):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
        if w:
            k = min(5, len(w))
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def edited(n=80, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(12)]
    texts = {}
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[i] = " ".join(w)
    return texts


def test_similar_pairs_against_brute_force(spark):
    texts = edited() | {1000: None, 1001: "", 1002: "!!", 1003: "one two", 1004: "One  two!", 1005: "x " * 60_000}
    df = spark.createDataFrame([(i, t, i) for i, t in texts.items()] + [(3, texts[3], 0)], "doc_id long, text string, id long")
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.similar_pairs(df, threshold=0.6).collect()}
    want = jaccard_truth(texts, 0.6)
    assert got <= want and len(got) >= 0.97 * len(want) and (1003, 1004) in got


def test_oversized_bands_lose_nothing(spark):
    texts = edited(60, 9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    small = {(r.doc_id_a, r.doc_id_b) for r in neardup.similar_pairs(df, threshold=0.6, max_bucket=2).collect()}
    assert small >= {(r.doc_id_a, r.doc_id_b) for r in neardup.similar_pairs(df, threshold=0.6).collect()} and small <= jaccard_truth(texts, 0.6)


def test_large_classes_are_reported_by_their_first(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h") for i in range(10)] + [(20, "a b c d e f g h i")], "doc_id long, text string")
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.similar_pairs(df, threshold=0.6, max_expanded=4).collect()}
    assert got == {(0, i) for i in range(1, 10)} | {(0, 20)}
    groups = {r.doc_id: (r.class_id, r.copies, r.links) for r in neardup.duplicate_groups(df, threshold=0.6).collect()}
    assert groups[7] == (0, 10, 1) and groups[20] == (20, 1, 1)


def test_near_duplicates_of_nothing(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [300, 1000, 3000, 10_000])
@pytest.mark.parametrize("heavy", [1.0, 1.5])
def test_sampler_estimates_weighted_jaccard(n, heavy):
    rng = np.random.default_rng(n)
    shared = n * 6 // 8  # plain Jaccard index 0.6
    keys = rng.integers(1, 2**63, 2 * n - shared, dtype=np.uint64)
    weights = np.full(len(keys), heavy)
    weights[:shared] = 1.0
    a, b = slice(0, n), np.concatenate([np.arange(shared), np.arange(n, len(keys))])
    s = neardup.Sampler(2000, 1.5).samples(np.concatenate([keys[a], keys[b]]), np.concatenate([weights[a], weights[b]]), np.array([0, n]))
    true = weights[:shared].sum() / weights.sum()
    assert abs((s[:, 0] == s[:, 1]).mean() - true) < 0.05


@pytest.mark.parametrize("n", [300, 1000, 3000, 10_000])
def test_recall_of_bands_where_edits_are_heavy(n):
    """Pairs at the threshold whose differing shingles have the largest weight and whose shared ones the least."""
    rng = np.random.default_rng(n)
    sampler = neardup.Sampler(24 * 3, neardup.spread_of(0.6))
    shared, tries = n * 6 // 8, 300 if n <= 1000 else 120
    hits = 0
    for _ in range(tries):
        keys = rng.integers(1, 2**63, 2 * n - shared, dtype=np.uint64)
        weights = np.where(np.arange(len(keys)) < shared, 1.0, 1.5)
        b = np.concatenate([np.arange(shared), np.arange(n, len(keys))])
        s = sampler.samples(np.concatenate([keys[:n], keys[b]]), np.concatenate([weights[:n], weights[b]]), np.array([0, n]))
        hits += (s[:, 0] == s[:, 1]).reshape(24, 3).all(1).any()
    assert hits >= 0.93 * tries  # 0.96 expected


def test_pages_of_one_notice_with_rare_words(spark):
    """40 pages of a common notice that differ in a run of words found nowhere else: all 780 pairs at about 0.67."""
    rng = random.Random(3)
    notice = [f"notice{i}" for i in range(170)]
    pages = {i: notice[:85] + [f"rare{i}x{k}" for k in range(34)] + notice[85:] for i in range(40)}
    texts = {i: " ".join(w) for i, w in pages.items()} | {1000 + i: " ".join(f"word{rng.randrange(900)}" for _ in range(150)) for i in range(1500)}
    want = {p for p in jaccard_truth({i: t for i, t in texts.items() if i < 1000}, 0.6)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id_a, r.doc_id_b) for r in neardup.similar_pairs(df, threshold=0.6).collect()}
    assert len(want) == 780 and got <= want and len(got) >= 0.95 * len(want)


def test_links_and_copies_give_all_pairs(spark):
    texts = edited(50, 5) | {i: "a b c d e f g h" for i in range(200, 270)} | {300: "a b c d e f g h i"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = neardup.class_links(df).collect()
    members = {}
    for r in rows:
        if r.kind == "copy":
            members.setdefault(r.doc_id_a, {r.doc_id_a}).add(r.doc_id_b)
    pairs = {tuple(sorted(p)) for m in members.values() for p in itertools.combinations(m, 2)}
    pairs |= {tuple(sorted((x, y))) for r in rows if r.kind == "link" for x in members.get(r.doc_id_a, {r.doc_id_a}) for y in members.get(r.doc_id_b, {r.doc_id_b})}
    want = jaccard_truth(texts, 0.6)
    assert pairs <= want and len(pairs) >= 0.97 * len(want) and members[200] == set(range(200, 270))


# --- 7: leakage


ITEM = "Meraklı fırıncı sahte bulmacayı üç kez sayarsa hangi kutu boş kalır ve kim yanılır diye sorulan eski bir soru burada bulunur lütfen dikkatle yanıtla sonra kaynağını da yaz"


def test_leaked_items(spark):
    words = ITEM.split()
    half, less = " ".join(words[: len(words) // 2 + 1]), " ".join(words[: len(words) // 2 - 3])
    replaced = words[:]
    replaced[6], replaced[14] = "başka", "yeni"
    other = " ".join(f"kelime{i}" for i in range(60))
    docs = [
        (1, f"{other} {ITEM} {other}"), (2, fold(ITEM).upper()), (3, f"{other} {half}. {other}"), (4, f"{less} {other}"), (5, " ".join(replaced)), (6, "> " + "\n> ".join([" ".join(words[:12]), " ".join(words[12:])])),
        (7, None), (8, ""), (9, "Bir soru."), (10, " ".join(reversed(words))), (11, other * 300 + " " + ITEM), (1, f"{other} {ITEM} {other}"),
    ]
    items = [(1, ITEM, "p"), (2, None, "p"), (3, "", "p"), (4, "!", "p"), (1, ITEM, "q")]
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")).collect()}
    assert got == {(i, 1) for i in (1, 2, 3, 5, 6, 11)}


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaked_items(docs, items).count() == 0
    assert leakage.leaked_items(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0
    assert leakage.leaked_items(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_SHINGLES", 50)
    items = spark.createDataFrame([(i, f"{ITEM} sayı{i} ek{i} son{i}") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert {r.item_id for r in leakage.leaked_items(docs, items).collect()} == set(range(5))


# --- 9: spam


PROSE = "The people of the town used to meet at the old harbour. In winter the market was closed, and nobody knew why it was so."


@pytest.mark.parametrize(
    ("text", "spam_page"),
    [
        ("cheap phone case shop best phone case deals cheap phone case prices " * 12, True),
        ("\n".join(f"https://shop{i}.test/item-{i} phone case" for i in range(15)), True),
        ("\n".join(f"Lamp Colour: red Size: M SKU: ABC-{1000 + i}" for i in range(12)), True),
        ("If you want Selport carpet then this Selport carpet is the Selport carpet for you. " * 10, True),
        (PROSE + "\n\n" + " ".join(f"#tag{i}word" for i in range(40)), True),
        (PROSE * 3, False),
        (PROSE + "\n\n#sea #harbour #town", False),
        ("\n".join(f"[{i}] https://site.example/{i} — {s}" for i, s in enumerate(["The report of the harbour office.", "A note on why the market was closed.", "What the miller wrote about the old bridge.", "An answer to it by the town.", "Letters from the time after the flood.", "The map that is kept in the museum."])), False),
        ("\n\n".join(f"{PROSE}\nAnd the wind came over the sea again." for _ in range(6)), False),
        ("def f(x):\n    return x + 1\n" * 20, False),
        ("", False),
        (None, False),
        ("one two three", False),
    ],
)
def test_spam(spark, text, spam_page):
    got = spam.keyword_pages(spark.createDataFrame([(1, text, "x"), (1, text, "y")], "doc_id long, text string, kind string")).collect()
    assert len(got) == spam_page


# --- 3: mojibake


WORDS = "yarıya kadar yağmur şehir için çarşı düştü köprü gözlüklü ağaç ışık sıcak kış güneş yıldız ölçü üzüm çiçek değirmen kıyı".split()


def garbled_docs():
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(9))
    docs, truth = [], {}
    for i in range(1, 41):
        rows = [line() for _ in range(4)]
        if i % 4 == 0:
            way = [lambda s: s.encode().decode("cp1252", "replace") if "�" not in s.encode().decode("cp1252", "replace") else s.encode().decode("latin-1"), lambda s: s.encode("cp1254").decode("cp1252"), lambda s: s.encode().decode("cp437")][i // 4 % 3]
            truth[i, 3] = rows[2]
            rows[2] = way(rows[2])
        docs.append((i, "\n".join([*rows, "", "Açıklama: “Ã¼” dizisi ve Þórvik köyü."])))
    return docs, truth


def test_garbled_lines(spark):
    docs, truth = garbled_docs()
    docs += [(90, None), (91, ""), (92, "a�b c"), (93, "this?that? nobody"), (94, "x" * 200_000), (4, docs[3][1])]
    got = {(r.ext_id, r.line_number): r for r in mojibake.garbled_lines(spark.createDataFrame([(i, t, 0) for i, t in docs], "ext_id long, text string, line_number int")).collect()}
    assert set(got) == set(truth) | {(92, 1)}
    assert sum(got[k].repaired == v for k, v in truth.items()) >= 0.9 * len(truth) and not got[92, 1].complete


def test_garbled_lines_of_nothing(spark):
    assert mojibake.garbled_lines(spark.createDataFrame([], "ext_id long, text string")).count() == 0


def test_alignment():
    assert mojibake.align("yarÄ±ya", "yarıya") == [("Ä±", "ı")]
    assert mojibake.align("yarya", "yarıya") is None


# --- 1 and 5: languages and pairs


SENTENCES = {
    "tr": "Köyün öğretmeni uzun kış boyunca eski haritaları inceledi ve kimseye haber vermedi. Pazar kurulduğunda halk yeni kuyular açtı çünkü su azdı. Bu bölümde yavaş bir dosya ile küçük bir sözlük karşılaştırılır. Yaşlı değirmenci o gece göl kıyısını gönüllü olarak temizledi.",
    "en": "The village teacher examined the old maps during the long winter and told nobody about it. When the market opened the people dug new wells because water was scarce. This section compares a slow file with a small dictionary. That night the old miller cleaned the shore of the lake as a volunteer.",
    "de": "Die Lehrerin des Dorfes untersuchte im langen Winter die alten Karten und sagte niemandem etwas davon. Als der Markt öffnete gruben die Leute neue Brunnen weil das Wasser knapp war. In derselben Nacht reinigte der alte Müller das Ufer des Sees.",
    "fr": "L’institutrice du village a examiné les anciennes cartes pendant le long hiver et n’a rien dit à personne. Quand le marché a ouvert les habitants ont creusé des puits parce que l’eau manquait. Cette nuit le vieux meunier a nettoyé la rive du lac.",
}


@pytest.fixture(scope="module")
def model():
    return language.fit_rows([(n, t + f" {i}") for n, t in SENTENCES.items() for i in range(8)])


def test_languages(model):
    assert all(model.segments(t)[0][0] == n and len(model.segments(t)) == 1 for n, t in SENTENCES.items())
    mixed = model.segments(SENTENCES["tr"] + "\n\n" + SENTENCES["fr"] + " " + SENTENCES["tr"])
    assert [s[0] for s in mixed] == ["tr", "fr", "tr"]
    assert model.segments("12 + 3 = 15\n4;5;6")[0][0] == model.segments("")[0][0] == "unknown"
    assert [s[0] for s in model.segments(fold(SENTENCES["tr"]))] == ["tr"]


@pytest.mark.parametrize(
    "text",
    [
        "La maestra del pueblo examinó los viejos mapas durante el largo invierno y no se lo dijo a nadie. Cuando abrió el mercado, la gente cavó nuevos pozos.",
        "Nauczycielka wsi badała stare mapy przez długą zimę i nikomu o tym nie powiedziała. Kiedy targ się otworzył, ludzie wykopali nowe studnie.",
        "qzkv xwpt jhgb mnrr vvkq ploz wexq zzty krpm bvcx qwtr plmn hgfd zxcq",
    ],
)
def test_other_languages_are_rejected(model, text):
    (lang, _, _), *rest = model.segments(text)
    assert lang == "unknown" and not rest


def test_many_runs_are_settled_in_time(model):
    import time

    text = "\n".join((SENTENCES["fr"] if i % 2 else SENTENCES["en"]).split(". ")[0] + "." for i in range(4000))
    began = time.time()
    assert {s[0] for s in model.segments(text)} <= {"en", "fr"} and time.time() - began < 20


def test_segments_of_ten_words():
    class Scripted(language.Languages):
        def __init__(self):
            pass

        def decide(self, plain):
            own = plain.split()
            best = "fr" if "le" in own else "tr"
            return (None if "vague" in own and len(own) < 10 else best, 0.7, best)

    host = "bir iki bes alti yedi sekiz dokuz on yirmi otuz kirk elli altmis yetmis seksen doksan yuz bin."
    found = lambda s: [x[0] for x in Scripted().segments(f"{host}\n\n{s}\n\n{host}")]
    assert found("le chat noir de la maison voit un chien et un oiseau.") == ["tr", "fr", "tr"]
    assert found("le chat noir de la maison voit. le chien est vague.") == ["tr", "fr", "tr"]  # a narrow sentence counts with its own
    assert found("le chat noir de la maison voit un chien.") == ["tr"]
    assert found("metinde “le chat noir de la maison voit un chien noir” terimi gecer.") == ["tr"]


def test_labels(spark):
    labels = [("tr-TR", "tr"), ("TURKISH", "tr"), ("eng", "en"), ("en_GB", "en"), (" Deutsch ", "de"), ("und", "unknown"), ("", None), (None, None), ("n/a", None), ("nl", "other")]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(labels)], "i int, t string").orderBy("i").select(language.label_language(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [b for _, b in labels]


def test_document_languages(spark, model):
    rows = [(1, SENTENCES["tr"], "tr", T0), (1, SENTENCES["tr"], "TR", T0 + datetime.timedelta(1)), (2, SENTENCES["en"], "tr", T0), (3, SENTENCES["de"] + "\n" + SENTENCES["en"], "de", T0), (4, None, "zxx", None), (5, "1 2 3", None, T0), (None, "x", "tr", T0), (6, SENTENCES["fr"] * 500, "fr", T0)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "ext_id long, text string, language string, loaded_at timestamp, lang string")
    got = {(r.ext_id, r.segment_no, r.lang) for r in language.mislabelled(df, model=model).collect()}
    assert got == {(2, 1, "en"), (3, 1, "de"), (3, 2, "en"), (5, 1, "unknown")}
    assert language.document_languages(df.limit(0), model=model).count() == 0


def test_defects(spark, model):
    en, tr = SENTENCES["en"].split(". "), SENTENCES["tr"].split(". ")
    good = [("What is a file?", "A file."), ("What is a well?", en[1] + "."), ("Kuyu nedir?", tr[1] + "."), ("Where is it?", "Selport"), ("Şunu Almancaya çevir: köprü", SENTENCES["de"]), ("What now?", "Consider these:\n- slow file\n- small one"), ("Why?", "To decline politely, say “I can't help with that” and smile at them."), ("What is x?", "It works.\n```python\nx = 1\n```")]
    bad = [("What is a lamp?", None, "empty"), ("What is a lamp?", " \n", "empty"), ("What is a lamp?", "N/A", "empty"), ("What is a lamp?", "Answer:", "empty"), ("What is a lamp?", "What is a lamp? What is a lamp?", "copy"), ("What is a lamp?", "I'm sorry, but I can't help with that.", "refusal"), ("Lamba nedir?", "Bu soruya yanıt veremiyorum.", "refusal"), ("What is a lamp?", en[0][:60], "truncated"), ("What is a lamp?", "It works.\n```python\nx = 1", "truncated"), ("Kuyu nedir?", SENTENCES["en"], "wrong_language")]
    rows = [(i, p, r, T0, "x") for i, (p, r) in enumerate(good * 12)] + [(1000 + i, p, r, T0, "y") for i, (p, r, _) in enumerate(bad)]
    rows += [(1000, "What is a lamp?", "old", T0 - datetime.timedelta(1), "z"), (None, "a", "b", T0, "z"), (2000, None, en[0] + ".", T0, "z"), (2001, "q", "x " * 50_000 + ".", T0, "z")]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, response string, loaded_at timestamp, defect string")
    got = {r.pair_id: r.defect for r in pairs.defects(df, model).collect()}
    assert got == {1000 + i: k for i, (_, _, k) in enumerate(bad)}
    assert pairs.defects(df.limit(0), model).count() == 0


def test_neighbours_across_parts(spark):
    texts = [f"{i:03d} text" for i in range(300)] + [f"{i:03d} text and more." for i in range(0, 300, 3)] + [f"{i:03d} text. More" for i in range(1, 300, 3)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {(r.h, r.size): r.within for r in pairs.shortened(spark.createDataFrame([(t,) for t in texts], "response string")).collect()}
    hashes = {r.h: r.t for r in spark.createDataFrame([(t.rstrip("."),) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {hashes[h]: w for (h, _), w in got.items()} == {f"{i:03d} text": i % 3 == 0 for i in range(300) if i % 3 < 2}


def test_evidence_decides_what_is_truncated(spark, model, monkeypatch):
    filler = [("What is %d?" % i, f"Item {i} is the folder that you want to see. Number {i} is not the one that you want to see.") for i in range(40)]
    cases = {
        "closed": ("What do rivers do?", "Rivers carry water to the sea."),  # a neighbour goes on within the sentence
        "longer": ("And what do rivers do?", "Rivers carry water to the sea and bring the silt along."),
        "sound": ("What shows files?", "Use the ls command in the folder that you want to see"),  # its last word closes sentences
        "new": ("What is a lamp?", "A lamp is a source of light. It stands on the table."),
        "short": ("Lamp?", "A lamp is a source of light."),  # goes on with a new sentence
        "open": ("What is a well?", "A well is a deep hole in the ground that gives"),
    }
    limited = {f"limit{i}": (f"Which village {i}?", f"The village {chr(97 + i)} see".ljust(25, "x")[:22] + " see") for i in range(12)}
    names = list(cases) + list(limited)
    rows = [(i, *v, T0) for i, v in enumerate([*cases.values(), *limited.values()])] + [(1000 + i, p, r, T0) for i, (p, r) in enumerate(filler)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, response string, loaded_at timestamp")
    found = lambda: {names[r.pair_id] for r in pairs.defects(df, model).collect() if r.defect == "truncated"}
    assert found() == {"closed", "open", *limited}
    monkeypatch.setattr(pairs, "shortened", lambda a: spark.createDataFrame([], "h long, size int, within boolean"))
    monkeypatch.setattr(pairs, "length_limits", lambda a: spark.createDataFrame([], "n int"))
    assert found() == {"open"}  # without neighbours and lengths the others are lost


# --- 6: personal data


def person_docs():
    given = ["Selin", "Kerem", "Judith", "Owen"]
    last = ["Taşyontar", "Akpınarlı", "Quillmere", "Bramby", "Hasdokur"]
    docs = []
    for i in range(40):
        name = f"{given[i % 4]} {last[i % 5]}"
        docs.append((i, f"Sorular için {name} ile user{i}@host{i}.test adresinden yazışılabilir. Kimlik no 123 456 789 0{i % 10} olan {name} dün aradı."))
    return docs


def test_personal_data(spark):
    cases = {
        100: ("Toplantıyı Owen Akpınarlı yönetti; Bramby, Judith geldi.", {("person_name", "Owen Akpınarlı"), ("person_name", "Bramby, Judith")}),
        101: ("Yaz: a.b [at] host [dot] test ya da x＠y.example, admin@example.org değil.", {("email", "a.b [at] host [dot] test"), ("email", "x＠y.example")}),
        102: ("Tel 0519 753 40 00, (717) 555-0141, +44 1632 960728. Build 555-4003-627, ISBN 978-361-7385-40-1.", {("phone", "0519 753 40 00"), ("phone", "(717) 555-0141"), ("phone", "+44 1632 960728")}),
        103: ("Evrak Kestane Sk. No: 12/3, Kumova adresine gitti. Kestane Sokağı boyunca yürüdük.", {("address", "Kestane Sk. No: 12/3")}),
        104: ("Send it to Flat 8, 145 Foundry Lane, Dorham. We walked along Orchard Street.", {("address", "Flat 8, 145 Foundry Lane")}),
        105: ("Kimlik no 87832228881 burada. Sipariş no 91356727735 kapandı.", {("id_number", "87832228881")}),
        106: ("Quillmere Köprüsü eski. Judith Bramby Library kapalı.", set()),
        107: ("", set()), 108: (None, set()),
    }
    rows = person_docs() + [(i, t) for i, (t, _) in cases.items()] + [(102, cases[102][0]), (None, "x@y.test"), (109, "kelime " * 30_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "ext_id long, text string, item string")
    got = pii.personal_data(df).collect()
    texts = dict(rows)
    for i, (_, want) in cases.items():
        assert {(r.pii_type, r.item) for r in got if r.ext_id == i} == want, i
    assert all(texts[r.ext_id][r.start_char - 1 : r.end_char] == r.item for r in got) and len(got) == len({(r.ext_id, r.start_char, r.pii_type) for r in got})
    clean = {r.ext_id: r.redacted for r in pii.redacted(df).collect()}
    assert clean[103] == "Evrak [ADDRESS] adresine gitti. Kestane Sokağı boyunca yürüdük." and clean[108] is None and clean[106] == cases[106][0]
    assert pii.personal_data(df.limit(0)).count() == 0


def test_rare_names_are_learnt_in_large_tables(spark):
    last = ("Kornwald", "Birkmoor", "Tannholt", "Zellhaus")
    rare = [(" ".join(f"ask for Zelda {x} at z{i}.{x.lower()}@post.org today." for x in last[: 2 + i % 3]),) for i in range(4)]
    plain = "the lamp is on the table and nobody is at the door of the house near the lake " * 3
    common = spark.range(2000).selectExpr("concat_ws(' ', transform(sequence(1, 30), i -> concat('we met Edwin ', element_at(array('Kornwald', 'Birkmoor', 'Tannholt', 'Zellhaus'), int(i % 4) + 1), ' at e', i, '@post.org today. " + plain + "'))) AS text")
    model = pii.learn(common.unionByName(spark.createDataFrame(rare, "text string")))
    assert {"edwin", "zelda"} <= model.given


def test_texts_full_of_numbers_take_linear_time():
    import time

    nothing = pii.Disclosure(frozenset(), frozenset(), frozenset())
    began = time.time()
    assert len(pii.items(" ".join(f"+44 1632 {960000 + i}," for i in range(30_000)), nothing)) == 30_000
    assert time.time() - began < 20


def test_counts_are_handed_on(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for _, t in person_docs()], "text string")
    whole = pii.learn(df)
    monkeypatch.setattr(pii, "MAX_HELD", 3)
    parts = pii.learn(df)
    assert whole.given and (whole.given, whole.surnames, whole.cues) == (parts.given, parts.surnames, parts.cues)


def test_cache_is_bounded():
    c = Cache(len, 3)
    assert [c[x] for x in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1] and len(c) <= 3


def test_queries_have_the_given_columns(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    want = {"p1_found": ["ext_id", "segment_no", "lang"], "p2_found": ["doc_id"], "p3_found": ["ext_id", "line_number"], "p4_found": ["doc_id_a", "doc_id_b"], "p5_found": ["pair_id", "defect"], "p6_found": ["ext_id", "start_char", "pii_type"], "p7_found": ["doc_id", "item_id"], "p8_found": ["mix_id", "source"], "p9_found": ["doc_id"]}
    for name, columns in want.items():
        rows = queries.queries()[name](spark, d)
        assert rows.columns == columns
        got = rows.collect()
        assert len(got) == len(set(got))


def test_band_records_are_shuffled_once_and_packed(spark):
    """band keys of 300 words' texts took some 1,500 bytes a document in two shuffles; packed they take under 24 * 23."""
    texts = edited(200, 4)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = neardup.collisions(df, neardup.word_frequencies(df), "doc_id", "text", 5, 24, 3, neardup.spread_of(0.6), neardup.MAX_BUCKET, 0.6)
    assert found.where("kind = 1").count() == len(texts) and found.where("kind = 0 and x < y").count() == found.where("kind = 0").count() > 0
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_a_part_passes_on_wide_bands_and_holds_little():
    n = 5_000
    key = np.where(np.arange(n) % 2, 7, np.arange(n)).astype(np.uint64)  # one band of every other class, the others alone
    record = np.concatenate([neardup._bytes(key, neardup.KEY), neardup._bytes(np.arange(n).astype(np.uint64), neardup.CLASS), neardup._bytes(np.arange(n), 8), neardup._bytes(np.full(n, 9, np.int32), 4)], 1)
    part = neardup.Part(64, 0.6, limit=1_000)
    rows = []
    for low in range(0, n, 500):
        rows += [r for b in part.add(record[low : low + 500].T.tobytes()) for r in b.to_pylist()]
    assert part.size < 4_000 and len(part.wide) == 1
    rows += [r for b in part.close() for r in b.to_pylist()]
    assert {r["kind"] for r in rows} == {2} and {r["x"] for r in rows} == set(range(1, n, 2))


def test_texts_beyond_the_broadcast_and_wide_neighbourhoods(spark, monkeypatch):
    texts = edited(60, 9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(r.doc_id_a, r.doc_id_b) for r in neardup.similar_pairs(df, threshold=0.6).collect()}
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 8)
    monkeypatch.setattr(neardup, "NEIGHBOURS", 2)
    assert {(r.doc_id_a, r.doc_id_b) for r in neardup.similar_pairs(df, threshold=0.6).collect()} == want


def test_weighted_similarity(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (2, "another text of many other words"), (3, None)], "doc_id long, text string")
    (got,), weights = neardup.near_duplicates(df, threshold=0.6)[0].collect(), neardup.near_duplicates(df, threshold=0.6, weigh=False)[0].collect()
    assert (got.a, got.b, got.similarity) == (1, 2, 0.8) and 0.5 < got.weighted <= 1 and weights[0].weighted is None


def test_the_fifth_form_of_a_skeleton_is_a_twin_too(spark):
    """four better known forms, whose ASCII pieces no garbling leads to, hid the twin."""
    words = [f"ö{x}ü{y}" for x in "bcd" for y in "xk"]
    decoys = [w.replace("ü", p) for w in words for p in "-/+=" for _ in range(3)]
    clean = "\n".join(decoys + words * 2)
    garbled = "\n".join(w.encode().decode("cp1252") for w in words)
    df = spark.createDataFrame([(1, clean), (2, garbled)], "ext_id long, text string")
    got = {(r.ext_id, r.line_number): r.repaired for r in mojibake.garbled_lines(df).collect()}
    assert got == {(2, k): w for k, w in enumerate(words, 1)}
