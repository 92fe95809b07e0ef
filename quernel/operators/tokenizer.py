"""A frozen piece tokenizer: texts to ids and back, and who may be tokenized.

A text is cut at white space, each word gets a word mark, and from left to right the longest piece that fits is taken; a
character that no piece fits becomes the byte pieces of its UTF-8 form. Ids of a text end with the end mark.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tokenizer: what separates words, the mark put before each, and the piece that ends a text.
SEPARATORS, WORD_MARK, END = re.compile(r"[ \t\r\n]+"), "▁", "</s>"
#: A vocabulary beyond this many pieces is refused: it is handed to every worker. Words that a worker remembers.
MAX_PIECES, MAX_WORDS = 2_000_000, 500_000


def vocabulary(pieces: DataFrame) -> dict[tuple[str, str], int]:
    """(kind, piece) -> id. Its size is checked before it is collected; a piece that occurs twice has its smallest id."""
    rows = pieces.where("piece is not null and piece != '' and piece_id is not null").groupBy("kind", "piece").agg(F.min("piece_id").alias("id")).limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return {(r.kind, r.piece): r.id for r in rows}


class Encoder:
    """Frozen: it can neither learn nor add pieces."""

    def __init__(self, table: dict[tuple[str, str], int]):
        self.normal = {p: i for (kind, p), i in table.items() if kind == "normal"}
        self.bytes = [table.get(("byte", f"<0x{b:02X}>"), -1) for b in range(256)]
        self.end = table.get(("control", END), -1)
        self.longest = max(map(len, self.normal), default=0)
        self.words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        known = self.words.get(word)
        if known is not None:
            return known
        text, out, at = WORD_MARK + word, [], 0
        while at < len(text):
            for size in range(min(self.longest, len(text) - at), 0, -1):
                if (piece := self.normal.get(text[at : at + size])) is not None:
                    out.append(piece)
                    at += size
                    break
            else:
                out += [self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        self.words[word] = out
        return out

    def text(self, text: str | None) -> list[int] | None:
        return None if text is None else [i for w in SEPARATORS.split(text) if w for i in self.word(w)] + [self.end]


def encode(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): token ids of every text, with the end mark. A null text has null ids."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary(pieces))
    fields = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        own = Encoder(table.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "ids": [own.text(t) for t in b.column(1).to_pylist()]}, schema=fields)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(tokens: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the text that ids spell, one space between words. Bytes that are no UTF-8 become replacement characters."""
    table = tokens.sparkSession.sparkContext.broadcast({i: (kind, p) for (kind, p), i in vocabulary(pieces).items()})
    fields = pa.schema([(id_col, pa.int64()), ("text", pa.string())])

    def spell(ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        out = bytearray()
        for i in ids:
            kind, piece = table.value.get(i, ("unknown", ""))
            out += bytes([int(piece[3:5], 16)]) if kind == "byte" else piece.encode("utf-8", "surrogatepass") if kind == "normal" else b""
        return out.decode("utf-8", "replace").replace(WORD_MARK, " ")[1:]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "text": [spell(i) for i in b.column(1).to_pylist()]}, schema=fields)

    return tokens.select(F.col(id_col).cast("long").alias(id_col), "ids").mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, byte_tokens, unknown, same): whether ids spell the text again, but for the kind and number of its
    white space and for word marks that it holds itself."""
    ids = encode(docs, pieces, id_col, text_col)
    table = vocabulary(pieces)
    low = [i for (kind, _), i in table.items() if kind == "byte"]
    back = decode(ids, pieces, id_col).withColumnRenamed("text", "_back")
    own = F.btrim(F.regexp_replace(text_col, r"[ \t\r\n]+", " "), F.lit(" "))
    joined = docs.select(F.col(id_col).cast("long").alias(id_col), own.alias("_own")).join(ids, id_col).join(back, id_col)
    bytes_ = F.size(F.filter("ids", lambda i: i.isin(*low))) if low else F.lit(0)
    return joined.select(id_col, F.size("ids").alias("n_tokens"), bytes_.alias("byte_tokens"), F.size(F.filter("ids", lambda i: i < 0)).alias("unknown"), (F.col("_own") == F.col("_back")).alias("same"))


def admission(docs: DataFrame, most: int, languages: tuple[str, ...] = ("tr", "en"), splits: tuple[str, ...] = ("train", "validation", "eval")) -> DataFrame:
    """(doc_id, pos, reason) of columns doc_id, pos, split, lang, text, size: the first reason for which a row is not
    tokenized, null if it is: missing_id, invalid_split, invalid_language, empty_text, duplicate_id (an earlier row by pos
    was taken under the id), cross_split_duplicate_text (the first taken row with the text is in another split),
    document_exceeds_shard_cap."""
    own = F.when(F.col("doc_id").isNull(), "missing_id").when(~F.coalesce("split", F.lit("")).isin(*splits), "invalid_split").when(~F.coalesce("lang", F.lit("")).isin(*languages), "invalid_language").when(F.coalesce("text", F.lit("")).rlike(r"^\s*\z"), "empty_text")
    d = docs.select("doc_id", "pos", "split", own.alias("own"), F.sha2("text", 256).alias("h"), F.col("size") > most)
    d = d.toDF("doc_id", "pos", "split", "own", "h", "large")
    taken = d.where("own is null and not large")
    # rows that a same id or text in another split keeps out never are the first of theirs
    first_id = taken.groupBy("doc_id").agg(F.min("pos").alias("first_id"))
    first_text = taken.groupBy("h").agg(F.min_by("split", "pos").alias("first_split"), F.min("pos").alias("first_text"))
    j = d.join(first_id, "doc_id", "left").join(first_text, "h", "left")
    crossed = (F.col("first_text") < F.col("pos")) & (F.col("first_split") != F.col("split"))
    reason = F.coalesce("own", F.when(F.col("first_id") < F.col("pos"), "duplicate_id").when(crossed, "cross_split_duplicate_text").when(F.col("large"), "document_exceeds_shard_cap"))
    return j.select("doc_id", "pos", reason.alias("reason"))


__all__ = ["Encoder", "admission", "decode", "encode", "round_trip", "vocabulary"]
