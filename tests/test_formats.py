"""Readers, sinks, markup, sequences and conversations."""

import bz2
import io
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quernel.functions import markup, sequences
from quernel.operators import chat
from quernel.sources import readers, sinks


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("x")).first().x


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "text": "a"}\nbroken\n{"id": 2}\n')
    assert readers.jsonl(spark, str(p), "id long, text string", strict=False).count() == 2
    assert [r.line for r in readers.rejected_lines(spark, str(p), "id long, text string").collect()] == ["broken"]
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        readers.jsonl(spark, str(p), "id long, text string").collect()
    with pytest.raises(ValueError):
        readers.read(spark, "nope", str(p))


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿ab".encode())
    (tmp_path / "pending").mkdir()
    (tmp_path / "pending" / "b.txt").write_bytes(b"no")
    (tmp_path / "c.txt").write_bytes(b"x\xff")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.repaired) for r in readers.texts(spark, str(tmp_path), "*.txt", repair=True, exclude=("pending",)).collect()}
    assert got == {"a.txt": ("ab", False), "c.txt": ("x�", True)}
    with pytest.raises(PySparkException):
        readers.texts(spark, str(tmp_path), "c.txt").collect()


def test_document_scans(spark):
    df = spark.createDataFrame([("p", "a\r\nb\n\n \n c\n"), ("q", ""), ("r", None)], "path string, text string")
    assert [r.text for r in readers.blank_line_documents(df).orderBy("path", "idx").collect()] == ["a\nb", "c"]
    df = spark.createDataFrame([("p", "x\n<s>\na\n</s>\n<s>\nb"), ("q", " plain "), ("r", "")], "path string, text string")
    assert [r.text for r in readers.marked_documents(df).orderBy("path", "idx").collect()] == ["<s>\na\n</s>", "<s>\nb", "plain"]
    df = spark.createDataFrame([("p", "# source: x\n# score: 3\na\n --- \nb\n---\n")], "path string, text string")
    assert [r.text for r in readers.scored_examples(df).orderBy("idx").collect()] == ["a", "b"]
    df = spark.createDataFrame([("p", "# bucket: a\n1\n# bucket: b\n2")], "path string, text string")
    assert [r.text for r in readers.bucket_examples(df).orderBy("idx").collect()] == ["# bucket: a\n1", "# bucket: b\n2"]


def test_wiki(spark, tmp_path):
    page = lambda i, ns, extra, text: f"<page><title>T{i}</title><ns>{ns}</ns><id>{i}</id>{extra}<revision><id>9</id><text>{text}</text></revision></page>"
    xml = "<mediawiki>" + page(1, 0, "", "'''Ab''' {{box|{{in}}}} [[c|d]] [[e]]&lt;ref&gt;r&lt;/ref&gt;\n== References ==\n== Life ==\nz") + page(2, 1, "", "talk") + page(3, 0, '<redirect title="T1" />', "r") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    got = readers.wiki_pages(spark, str(tmp_path / "d.xml.bz2")).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, "Ab  d e \n\nLife\n\nz".replace("Ab  d e ", "Ab  d e"))]


def test_tar(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:bz2") as t:
            for n, data in members:
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    archive("a.tar.bz2", [("b.txt", b"two"), ("a.txt", b"one"), ("../x.txt", b"bad"), ("c.bin", b"no"), ("d.txt", b"\xff"), ("e.txt", b"y" * 50)])
    got = [(r.member, r.text) for r in readers.tar_members(readers.files(spark, str(tmp_path), "a.tar.bz2"), (".txt",), most=40).collect()]
    assert got == [("a.txt", "one"), ("b.txt", "two"), ("d.txt", None)]
    archive("s.tar.bz2", [("x/sentences_detailed.csv", "1\ttur\tBir\tali\t\n2\tdeu\tEin\tu\n3\teng\tOne\t\n4\teng\tTwo\tme\nbad\n".encode())])
    got = [(r.sentence_id, r.language, r.text, r.user) for r in readers.sentence_table(readers.files(spark, str(tmp_path), "s.tar.bz2")).collect()]
    assert got == [("1", "tr", "Bir", "ali"), ("4", "en", "Two", "me")]


def test_api_and_xml(spark):
    df = spark.createDataFrame([('{"results": [{"title": "a", "description": "b"}]}',), ('{"response": {"docs": [{"title": "c", "abstract": ["d", "e"]}]}}',), ("{",)], "body string")
    assert sorted(r.text for r in readers.api_results(df).collect()) == ["a\n\nb", "c\n\nd\ne"]
    got = readers.xml_texts(spark.createDataFrame([("<a>x<b>y</b></a>",), ("<a>",), (None,)], "body string")).collect()
    assert [(r.text, r.failed) for r in got] == [("x y", False), (None, True), (None, False)]


def test_markup(spark):
    assert one(spark, "<p>A <b>b</b></p><script>x</script><div>c</div>", markup.html_text) == "A b\nc"
    assert one(spark, "a <b>c", markup.strip_tags) == "a  c" and one(spark, "1 < 2", markup.strip_tags) == "1 < 2"
    assert one(spark, '<a class="k" href="/u">x</a> <a href=\'v\'>', markup.links) == ["/u", "v"]
    assert markup._without("a{{b{{c}}d}}e}}", "{{", "}}") == "ae}}" and markup._without("a{{b", "{{", "}}") == "a"
    assert one(spark, "Title\n=====\n" + "p " * 300 + "\n\nNext\n----\nq", lambda c: markup.rst_sections(c, 1000, 10)) == ["Title\n" + ("p " * 300).strip(), "Next\nq"]
    assert one(spark, "﻿a  b  c\nx\n```\n  y   z\n```\n", markup.clean_lines) == "a b c\n```\n  y   z\n```"
    assert one(spark, 'ok: ```json\n["a", "b"]\n```', markup.json_array) == ["a", "b"] and one(spark, "none", markup.json_array) is None


def test_sequences(spark):
    arrays = [[1, 1, 2], [], [1, 2, 1, 2], [5]]
    got = [one(spark, a, lambda c: F.struct(sequences.repetition_ratio(c).alias("r"), sequences.repeated_ngram(c).alias("n"), sequences.longest_run(c).alias("l")), "array<int>") for a in arrays]
    assert [(round(g.r, 3), g.n, g.l) for g in got] == [(0.667, False, 2), (1.0, False, 0), (0.5, True, 1), (1.0, False, 1)]
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 3, 4, 5]), ([], [1]), ([7], [7])], "a array<int>, b array<int>")
    rows = df.select(sequences.common_prefix(F.col("a"), F.col("b")).alias("p"), sequences.prompt_overlap(F.col("a"), F.col("b")).alias("o"), sequences.longest_common_span("a", "b").alias("s")).collect()
    assert [tuple(r) for r in rows] == [(2, 2, 2), (0, 0, 0), (1, 1, 1)]
    assert one(spark, [0, 65_535, 7], lambda c: sequences.unpack_uint16(sequences.pack_uint16(c)), "array<int>") == [0, 65_535, 7]
    with pytest.raises(PySparkException):
        one(spark, [65_536], sequences.pack_uint16, "array<int>")
    assert [one(spark, t, sequences.balanced) for t in ("(a[b]{})", "(]", "((", "", "a)")] == [True, False, False, True, False]
    assert [one(spark, t, sequences.parses_as_python) for t in ("x = 1", "x =", None)] == [True, False, None]
    assert spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(sequences.match_ratio("a", "b")).first()[0] == 0.75


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", " r "), (1, 4, "assistant", "again"), (1, 5, "human", "c"), (1, 6, "gpt", ""), (1, 7, "bot", "d"), (2, 0, "assistant", "x"), (2, 1, "user", None), (3, 0, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.conv, r.prompt, r.response) for r in chat.all_pairs(df).orderBy("conv", "turn").collect()] == [(1, "b", "r"), (1, "c", "d")]
    assert [(r.conv, r.prompt, r.response) for r in chat.first_pairs(df).collect()] == [(1, "b", "r")]


def test_scores(spark):
    rows = [("İstanbul ve Ankara", ["istanbul", "izmir"], None, None), ("x", [], None, None), ("a b", ["z"], ["A b"], None), ("a b", ["z"], None, [["q", "a"], ["b"]]), ("a b", ["z"], None, [["q"]]), (None, ["z"], [], [])]
    df = spark.createDataFrame(rows, "answer string, expected_keywords array<string>, accepted_phrases array<string>, keyword_groups array<array<string>>")
    got = chat.scored(df).collect()
    assert [r.passed for r in got] == [False, True, True, True, False, False] and got[0].matched_keywords == ["istanbul"]


def test_supervised(spark):
    r = spark.createDataFrame([([1, 2], [1, 2, 3, 4, 9])], "p array<int>, f array<int>").select(chat.supervised(F.col("p"), F.col("f"), 6).alias("x")).first().x
    assert r.input_ids == [1, 2, 3, 4, 0, 0] and r.labels == [-100, 3, 4, 9, -100, -100]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", "train"), (2, "a", "eval")], "doc_id long, text string, split string")
    sinks.jsonl(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"doc_id":1,"split":"train","text":"b"}', '{"doc_id":2,"split":"eval","text":"a"}']
    with pytest.raises(PySparkException):
        sinks.jsonl(df, str(tmp_path / "j"))
    sinks.append_unseen(df, str(tmp_path / "u"))
    sinks.append_unseen(df.union(spark.createDataFrame([(3, "B", "x"), (4, "c", "x")], df.schema)), str(tmp_path / "u"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "u")).collect()) == ["a", "b", "c"]
    sinks.partitioned_text(df, str(tmp_path / "t"), "split", wrap=True)
    assert "<s>" in [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]


def test_token_shards(spark, tmp_path):
    docs = {i: list(range(i * 10, i * 10 + 3 + i % 4)) for i in range(12)}
    df = spark.createDataFrame([("train" if i % 3 else "eval", i, ids) for i, ids in docs.items()], "split string, doc_id long, token_ids array<int>")
    path = str(tmp_path / "shards")
    bounds = sinks.token_shards(df, path, capacity=12).collect()
    for b in bounds:
        assert sinks.read_tokens(spark, path, b.split, b.shard, b.start_offset, b.end_offset - b.start_offset) == docs[b.doc_id]
    back = spark.createDataFrame(bounds)
    assert sinks.shard_faults(spark, path, back).count() == 0
    assert sinks.shard_faults(spark, path, back.where("doc_id != 0")).count() == 1


def test_nested(spark):
    from quernel.functions import nested

    assert one(spark, '{"b": ["u\\u0308\\u0000"], "a": 1}', nested.normalized_json) == '{"a": 1, "b": ["ü"]}' and one(spark, "{", nested.normalized_json) is None
    assert one(spark, '{"prompt": "p", "x": [{"text": ["t", {"y": "no"}]}], "z": "no"}', nested.strings_under) == ["p", "t"]
    rows = [(1, i, p) for i, p in enumerate(["a", "<0xC3>", "<0xBC>", "b", "<0xFF>"])]
    got = nested.byte_runs(spark.createDataFrame(rows, "id long, pos int, piece string"), ["id"]).orderBy("start").collect()
    assert [(r.start, r.length, r.text) for r in got] == [(1, 2, "ü"), (4, 1, None)]


def test_joins(spark, tmp_path):
    from quernel.operators import joins

    a, b = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i long, x string"), spark.createDataFrame([(10, "p"), (20, "q")], "i long, y string")
    got = joins.zip_by_position(a, b, [F.col("i")], [F.col("i")]).orderBy("position").collect()
    assert [(r.l.x, r.r.y if r.r else None) for r in got] == [("a", "p"), ("b", "q"), ("c", None)]
    e, f = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "f string, h string"), spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "f string, h string")
    assert {r.f: r.fault for r in joins.manifest_faults(e, f, "f", "h").collect()} == {"b": "different", "c": "missing", "d": "unexpected"}
    first = joins.reused(a, "t", {"v": 1}, str(tmp_path))
    assert joins.reused(a.limit(0), "t", {"v": 1}, str(tmp_path)).count() == first.count() == 3 and joins.reused(a.limit(0), "t", {"v": 2}, str(tmp_path)).count() == 0


def test_inventory(spark):
    from quernel.plans.inventory import inventory, report

    base = "the and of to in is for that with as on by from or an this are be it was can which at not has have "
    other = " ".join(f"the item{i} of that" for i in range(120)) + " "
    para = "this is the long paragraph that stands in two of the documents and that must be cut from the later one of them"
    docs = [(1, base * 2, "en"), (2, base.upper() * 2, "en"), (3, "short", "en"), (4, None, "en"), (5, other + "\n\n" + para, "en"), (6, other + "more of it\n\n" + para, "en"), (7, para + " and of the item", "en"), (8, "ve bir bu için " * 20, "tr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    items = spark.createDataFrame([(para + " and of  the ITEM",)], "text string")
    got = {r.doc_id: r for r in inventory(df, items).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: "accepted", 2: "post_dedup_too_short", 3: "too_short", 4: "too_short", 5: "accepted", 6: "near_duplicate", 7: "too_short", 8: "accepted"} | {7: got[7].reason}
    assert got[2].removed_paragraphs == 1 and got[6].representative_id == 5 and got[6].removed_paragraphs == 1 and got[7].reason in ("evaluation_contamination", "too_short")
    text = report(df.groupBy("lang").count(), "By language")
    assert text.startswith("# By language\n\n| lang | count |")
    with pytest.raises(ValueError):
        report(df, "x", 2)


def test_inventory_refuses_contained_items(spark):
    from quernel.plans.inventory import inventory

    base = "the and of to in is for that with as on by from or an this are be it was can which at not has have "
    item = "where does the old river of the north turn to the sea"
    rows = [(1, base * 2 + "Where does  the OLD river\nof the north turn to the sea and so on", "en"), (2, base + " ".join(f"the item{i} of that" for i in range(60)), "en"), (3, base + "the ferry of the lake is not on time " + " ".join(f"of place{i} to the" for i in range(60)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    items = spark.createDataFrame([("the ferry of the lake", item), (None, None)], "prompt string, text string")
    assert {r.doc_id: r.reason for r in inventory(df, items).collect()} == {1: "evaluation_contamination", 2: "accepted", 3: "accepted"}  # a prompt of under 40 characters is none
    longer = items.select(F.concat("prompt", F.lit(" is not on time of place0")).alias("prompt"), "text")
    assert {r.doc_id: r.reason for r in inventory(df, longer).collect()} == {1: "evaluation_contamination", 2: "accepted", 3: "evaluation_contamination"}


def test_inventory_runs_its_first_filter_once(spark):
    """every branch of the later stages ran the filter over whole texts anew; only written results go on."""
    from quernel.plans.inventory import inventory

    df = spark.createDataFrame([(1, "short", "en"), (2, "the and of to in is for that with " * 8, "en")], "doc_id long, text string, lang string")
    out = inventory(df, spark.createDataFrame([(None,)], "text string"))
    assert "_raw" not in out._jdf.queryExecution().analyzed().toString() and {r.doc_id: r.reason for r in out.collect()} == {1: "too_short", 2: "accepted"}
