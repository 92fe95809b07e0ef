"""Instruct filters, cleaners, tokenizer, allocation, health: edge cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import clean, markup
from quernel.operators import allocate, health, instruct, mojibake, tokenizer


def reasons(spark, rows, reason, more=("source", "category")):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, prompt string, response string, source string, category string")
    d = instruct.with_texts(df, more=more).withColumn("kind", instruct.mix_category())
    return [r.x for r in d.orderBy("i").select(reason().alias("x")).collect()]


def pair(p, r, s=None, c=None):
    return (p, r, s, c)


def test_chat_reasons(spark):
    ok = "A sound answer of some length."
    rows = [pair(None, ok), pair(" ", ok), pair("q", None), pair("q", "short"), pair("q", "x " * 500), pair("q " * 300, ok), pair("q", "I am ChatGPT, and this is me"), pair("q", "see http://a.b for more of it"), pair("q", "mail to me@site.org for more"), pair("q", "call 555 123 4567 for more of it"), pair("q", "api_key = abcdefghijkl12345 here"), pair("q", ok)]
    assert reasons(spark, rows, instruct.chat_reason) == ["empty_prompt", "empty_prompt", "empty_response", "response_too_short", "response_too_long", "prompt_too_long", "blocked_identity_phrase", "url", "email", "phone", "secret_or_api_key", None]


def test_software_and_support_reasons(spark):
    soft = [pair("git commit nedir?", "Değişiklikleri kaydeden komuttur, sık kullanılır."), pair("Nedir?", "Ali, Veli, Ayşe, Fatma, Hasan, Mehmet"), pair("Nedir?", "Bu bir göl ve çok güzel bir yerdir."), pair("q", "PORNO içerik burada yer almaz hiç."), pair("q", "Monty Python ve python ile ilgili bir film.")]
    assert reasons(spark, soft, instruct.software_reason) == [None, "name_list", "not_software_related", "adult_content", "not_software_related"]
    support = [pair("Kendimi çok kötü hissediyorum", "Bir mola ver ve bugün sadece küçük bir adım at."), pair("Bunu çevir", "Bir mola ver ve küçük bir adım at şimdi."), pair("Kendimi kötü hissediyorum", "Silah almak iyi bir fikir olmazdı burada.")]
    assert reasons(spark, support, instruct.support_reason) == [None, "task_noise", "violent_or_hate_context"]
    assert reasons(spark, support, lambda: instruct.support_reason(True)) == [None, None, "violent_or_hate_context"]


def test_mix_and_distill_reasons(spark):
    own = "selbot"
    rows = [pair("ChatGPT misin?", "Hayır, ben Selbot adında bir modelim.", "local_identity"), pair("ChatGPT misin?", "Evet, ben ChatGPT adında bir modelim."), pair("Terminal nerede?", "Terminal bilgisi uçak biletinde yazar.", None, "programming"), pair("Python nedir?", "Python bir programlama dilidir, import ile modül alınır.", None, "programming"), pair("x", "Bugün hava güzel ve sıcak olacak.")]
    assert reasons(spark, rows, lambda: instruct.mix_reason(own)) == [None, "blocked_identity_phrase", "software_false_positive", None, None]
    rows = [pair("Kimsin?", "Ben Selbot, bir yardımcıyım burada.", None, "identity"), pair("Kimsin?", "Ben Selbot, bir yardımcıyım burada."), pair("q", "I am Qwen and I can answer that."), pair("q", "A keylogger is what you would write.")]
    assert reasons(spark, rows, lambda: instruct.distill_reason(own)) == [None, "own_identity_leak", "qwen_identity_contamination", "unsafe_cyber"]


def test_cleaners(spark):
    df = spark.createDataFrame([("a\r\n\n\n\nb  \t c ", "{{x}} [[A|b]] <ref>z</ref> ''c''\n\n d", "One two three four.  Five six\n \nseven " + "word " * 20)], "a string, b string, c string")
    r = df.select(clean.corpus_clean(F.col("a")).alias("a"), clean.wiki_pilot(F.col("b")).alias("b"), clean.chunks(F.col("c"), 10).alias("c")).first()
    assert r.a == "a\n\nb c" and r.b == "b   c\nd" and r.c[:2] == ["One two three four.", "seven " + " ".join(["word"] * 20)]
    out = spark.createDataFrame([("P: x\nAsistan: y\nKullanıcı: z</s> w", "P: x\n"), ("y", "zz"), (None, "a"), ("", "")], "o string, p string").select(clean.answer_of(F.col("o"), F.col("p")).alias("x")).collect()
    assert [o.x for o in out] == ["y", "y", None, ""]


def test_dialogues(spark):
    text = "# bucket: a\nKullanıcı: q\n```\nKullanıcı: in code\n```\nAsistan: r\nKullanıcı: q2\nAsistan: r2"
    got = clean.dialogues(spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "plain")], "id long, text string"), "id", "text").orderBy("id", "n").collect()
    assert [(r.id, r.n, r.example.split("\n")[0]) for r in got] == [(1, 0, "# bucket: a"), (1, 1, "Kullanıcı: q"), (1, 2, "Kullanıcı: q2"), (4, 0, "plain")]


def test_html(spark):
    cases = ["<nav><div>a</nav>b<br/>c &amp; d", "x<header>y<footer>z</header>w", "<script>a<b</script>t", "<p title='a>b'>q</p>r", "<style>unclosed", None, "<svg/>s", "a < b"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(markup.html_text("c").alias("x")).collect()
    assert [r.x for r in got] == ["b\nc & d", "x w", "t", "q\nr", "", None, "s", "a < b"]


PIECES = [(0, "</s>", "control"), *[(1 + b, f"<0x{b:02X}>", "byte") for b in range(256)], (300, "▁", "normal"), (301, "▁ab", "normal"), (302, "c", "normal"), (303, "▁a", "normal"), (304, "bc", "normal")]


def test_tokenizer(spark):
    pieces = spark.createDataFrame(PIECES, "piece_id int, piece string, kind string")
    docs = spark.createDataFrame([(1, "abc  ab\tax"), (2, None), (3, ""), (4, "é▁"), (5, "c" * 50_000)], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in tokenizer.encode(docs, pieces).collect()}
    assert ids[1] == [301, 302, 301, 303, 1 + ord("x"), 0] and ids[2] is None and ids[3] == [0] and ids[5] == [300] + [302] * 50_000 + [0]
    trip = {r.doc_id: r for r in tokenizer.round_trip(docs, pieces).collect()}
    assert trip[1].same and trip[1].byte_tokens == 1 and trip[3].same and not trip[4].same and trip[5].same
    assert tokenizer.encode(docs.limit(0), pieces).count() == 0


def test_admission(spark):
    rows = [(1, 1, "train", "tr", "a", 5), (1, 2, "train", "tr", "b", 5), (2, 3, "eval", "tr", "a", 5), (3, 4, "train", "tr", "a", 5), (4, 5, "train", "de", "c", 5), (5, 6, "x", "tr", "c", 5), (6, 7, "train", "tr", " ", 5), (None, 8, "train", "tr", "d", 5), (7, 9, "train", "en", "e", 50), (8, 10, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, split string, lang string, text string, size long")
    got = {r.pos: r.reason for r in tokenizer.admission(df, 10).collect()}
    assert got == {1: None, 2: "duplicate_id", 3: "cross_split_duplicate_text", 4: None, 5: "invalid_language", 6: "invalid_split", 7: "empty_text", 8: "missing_id", 9: "document_exceeds_shard_cap", 10: "invalid_split"}


def test_unique_budget_is_the_ordered_pass(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i, rng.randint(1, 9), f"h{rng.randint(0, 40)}", f"{rng.random():.6f}") for i in range(120)] + [(None, 500, 1, "x", "0"), ("a", 501, None, "y", "0"), ("a", 502, 1, None, "0")]
    df = spark.createDataFrame(rows, "source string, doc_id long, n_tokens long, h string, k string")
    sizes = {}
    for s, i, n, h, k in rows:  # equal contents have one size
        if h and n:
            sizes.setdefault(h, n)
    df = df.join(spark.createDataFrame(list(sizes.items()), "h string, z long"), "h", "left").select("source", "doc_id", F.col("z").alias("n_tokens"), "h", "k")
    seen, want = set(), []
    for source in "abc":
        total = 0
        for s, i, _, h, k in sorted((r for r in rows if r[0] == source and r[2] and r[3]), key=lambda r: (r[4], r[1])):
            if h in seen or total >= 40 or total + sizes[h] > 44:
                continue
            total += sizes[h]
            seen.add(h)
            want.append((s, i, total))
    picked, refused = allocate.unique_budget(df, 40, 44)
    assert sorted(map(tuple, picked.collect())) == sorted(want)
    assert {r.source for r in refused.collect()} <= {"b", "c"}
    assert allocate.unique_budget(df.limit(0), 40, 44)[0].count() == 0


def test_target_counts_is_the_ordered_pass(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xyz"), rng.choice("pq"), f"{rng.random():.6f}") for i in range(200)] + [(900, None, "p", "0")]
    targets = {"a": {"x": 7, "y": 3}, "b": {"p": 5, "q": 9}}
    left, want = {c: dict(t) for c, t in targets.items()}, []
    for i, a, b, k in sorted(rows, key=lambda r: (r[3], r[0])):
        if left["a"].get(a, 0) > 0 and left["b"].get(b, 0) > 0:
            left["a"][a] -= 1
            left["b"][b] -= 1
            want.append(i)
    df = spark.createDataFrame(rows, "doc_id long, a string, b string, k string")
    got = allocate.target_counts(df, "doc_id", F.col("k"), targets).orderBy("rank").collect()
    assert [r.doc_id for r in got] == want


def test_interleaved_spreads_groups(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(40)] + [(100, None)]
    got = allocate.interleaved(spark.createDataFrame(rows, "doc_id long, g string"), "g", "doc_id", "s").orderBy("position").collect()
    assert [r.position for r in got] == list(range(41)) and len({r.doc_id for r in got}) == 41
    for n in range(1, 42):
        assert abs(sum(r.g == "b" for r in got[:n]) - n * 10 / 41) <= 1.0
    assert allocate.interleaved(spark.createDataFrame([], "doc_id long, g string"), "g", "doc_id", "s").count() == 0


def test_allocation_fills_dedicated_sources_first(spark):
    rows = [("m", "tr", 50), ("m", "en", 80), ("t", "tr", 30), ("e", "en", 40), ("e2", "en", 90), ("x", "de", 5)]
    got = {(r.source, r.lang): r.allocated for r in allocate.allocation(spark.createDataFrame(rows, "source string, lang string, available long"), {"tr": 60, "en": 100}, 70).collect()}
    assert got == {("t", "tr"): 30, ("m", "tr"): 30, ("e", "en"): 40, ("e2", "en"): 60, ("m", "en"): 0}


def test_health(spark):
    rows = [(1, "", ["empty_output", "repetition"]), (2, "all is well here today", []), (3, "x � y z w", ["decoder_defect"]), (4, "a b c Ã¼ d", ["confirmed_text_mojibake"]), (5, "one два three", ["unexpected_script", "mixed_script"]), (6, "no no no no", ["repetition"]), (7, "end of this text </s>", ["special_token_leakage"]), (8, None, ["empty_output", "repetition"])]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "i int, t string")
    assert {r.i: r.findings for r in health.findings(df, "i", "t").collect()} == {i: f for i, _, f in rows}
    assert health.findings(df.limit(0), "i", "t").count() == 0 and health.summary(df, "t").first().generations == 8


@pytest.mark.parametrize(("text", "was"), [("Ã¼", "ü"), ("ÃƒÂ¼", "ü"), ("TÃ¼rkiye", "Türkiye"), ("plain", None), ("Ã", None)])
def test_guessed_repair(text, was):
    assert mojibake.guess(text) == was


def test_mojibake_findings(spark):
    df = spark.createDataFrame([(1, "sound\nKullanÄ±cÄ± � x"), (2, None), (3, "Â"), (None, "Ã¼")], "ext_id long, text string")
    got = {(r.ext_id, r.line_number, r.substring): (r.original, r.severity, r.safe) for r in mojibake.findings(df).collect()}
    assert got[1, 2, "�"] == (None, "critical", False) and got[1, 2, "KullanÄ±cÄ±"] == ("Kullanıcı", "high", True) and got[1, 2, "Ä±"] == ("ı", "high", True) and {k[0] for k in got} == {1}


def test_scored_examples(spark):
    good = "Kullanıcı: python nedir?\nAsistan: Python, fonksiyon ve liste yazılan bir dildir."
    rows = [(1, good), (2, good), (3, None), (4, "Kullanıcı: soru nedir?\nAsistan:"), (5, "Kullanıcı: kısa soru nedir?\nAsistan: Kısa soru nedir?"), (6, good + "\n```"), (7, good + "\nSubscribe to the newsletter"), (8, good * 200)]
    got = {r.id: r for r in instruct.scored_examples(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got[1].accepted and got[1].score == 2 + 3 + 2 + 1 + 1 and got[2].negatives == ["duplicated exact example"] and not got[2].accepted
    assert got[3].negatives == ["too short"] and "empty answer" in got[4].negatives and "answer repeats question" in got[5].negatives and got[6].negatives == ["broken code fences"] and got[7].negatives == ["web boilerplate"] and "too long" in got[8].negatives
    assert [i for i, r in got.items() if r.accepted] == [1]


def test_stream_forgets_within_watermark(spark, tmp_path):
    import datetime

    from quernel.streaming import resume

    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", at), (2, "a", at), (3, "b", None)], "doc_id long, text string, ingested_at timestamp").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert resume.deduplicated_stream(spark, str(tmp_path), root=str(tmp_path / "s"), within=("ingested_at", "1 day")).count() == 2


def test_formats_by_name(spark, tmp_path):
    import io
    import tarfile

    from quernel.sources import readers

    (tmp_path / "a.txt").write_text("one\n\ntwo", encoding="utf-8")
    assert readers.read(spark, "blank_lines", str(tmp_path / "a.txt")).count() == 2
    long = "a paragraph of the page that is long enough to be kept here"
    page = f"<page><title>T</title><ns>0</ns><id>1</id><revision><id>77</id><text>{long}\n\nshort\n\n{long} too</text></revision></page>"
    (tmp_path / "w.xml").write_text(f"<mediawiki>{page}<page><title>D</title><ns>1</ns><id>2</id><revision><id>8</id><text>{long}</text></revision></page></mediawiki>", encoding="utf-8")
    got = readers.read(spark, "wiki_paragraphs", str(tmp_path / "w.xml")).orderBy("n").collect()
    assert [(r.page_id, r.revision_id, r.n, r.paragraph) for r in got] == [(1, 77, 0, long), (1, 77, 1, long + " too")]
    with tarfile.open(tmp_path / "t.tar", "w") as archive:
        for name in ("doc/a.md", "vendor/b.md", "doc/c.bin", "doc/d.GO"):
            info = tarfile.TarInfo(name)
            info.size = 1
            archive.addfile(info, io.BytesIO(b"x"))
    members = readers.read(spark, "tar", str(tmp_path / "t.tar")).withColumn("source_id", F.lit("s"))
    assert {(r.member, r.category) for r in readers.member_sample(members, "1", 5).collect()} == {("doc/a.md", "technical_documentation"), ("doc/d.GO", "code_structured_text")}
    assert readers.member_sample(members, "1", 1).count() == 1 and readers.member_sample(members, "1", 5, within={"s": ("/none/",)}).count() == 0
    with pytest.raises(ValueError, match="unknown format"):
        readers.read(spark, "nothing", "x")
