"""Problem 3: lines that came through a wrong character decoding, and their original text where possible.

1. One pass over the texts keeps the lines that may be garbled and counts the clean words with letters beyond ASCII.
2. Garbled words are joined with clean near-twins: words that are equal once everything but ASCII letters and digits is
   stripped. Aligning a garbled word with its twin shows which characters became what.
3. From the aligned pieces, weighted by the number of different words that show them, the *transformations* are inferred
   (written in one encoding, read in another, also twice) that explain them; pieces that no transformation explains are
   kept as mappings of their own if enough words agree.
4. The inferred transformations are applied to all remaining lines, also to words without a twin.

A line is garbled if a word of it holds a piece of several characters of an inferred transformation, a replacement or C1
control character, or if putting single characters right makes it a known clean word. Pieces that stand alone between
quotation marks are quoted to explain the effect and don't count; rare letters without twin evidence don't either.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import arrow_map

# Letters beyond ASCII of the four languages, typographic marks and symbols of clean text.
LETTERS = "çğıöşüâîûÇĞİÖŞÜÂÎÛäßÄàæéèêëïôœùÿÀÆÉÈÊËÏÔŒÙŸ"
MARKS = "“”‘’„«»–—…•€°·"

#: (written in, read in): the ways of garbling that are tried.
WRITTEN = ("utf-8", "cp1254", "cp857", "cp850", "cp437", "iso8859-9", "cp1252", "mac_roman", "mac_turkish")
READ = ("cp1252", "latin-1", "cp1254", "cp437", "cp850", "cp857", "mac_roman", "mac_turkish", "cp1251", "iso8859-9", "koi8-r", "cp1250")

LOST = "�"
#: Letters of other scripts and box drawing, which don't stand alone in these languages.
_FOREIGN = re.compile(r"[\u0370-\u058f\u2500-\u25ff]")
_C1 = re.compile(r"[\x80-\x9f]")
_RARE = re.compile(rf"[^\x00-\x7f{re.escape(LETTERS + MARKS)}]")
_LEAD = "Â-ß"
_FOLLOW = "\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_RUN = re.compile(rf"[{_LEAD}][{_FOLLOW}]|[à-ï][{_FOLLOW}]{{2}}")
_INSIDE = re.compile(r"\w\?\w|(?:^|[ \t])\?(?:\w|[ \t])|\?[^\x00-\x7f\s]|[”…][^\W\d_]|[^\W\d_]„|[a-z][ÂÎÛÇĞİÖŞÜÄÀÆÉÈÊËÏÔŒÙŸ]{2}")
_ALONE = re.compile(r"(?:^|[ \t])(?:[^\x00-\x7f\w]+|\?)(?=[ \t]|$)")
_SPLIT = re.compile(r"[^A-Za-z0-9]+")
_EDGE = ".,;:!?()[]{}<>*\"'`|/\\"
_QUOTES = "“”„‘’«»\"'`"

MIN_SUPPORT = 3
MAX_PIECES = 200_000
#: A piece of ASCII characters alone, to which nothing garbled can lead.
_ASCII_PIECE = r"(?:^|[A-Za-z0-9])[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(?:$|[A-Za-z0-9])"


def suspicious(text: str) -> bool:
    """Whether a line or word may be garbled (cheap, errs on the side of yes)."""
    if text.isascii():
        return "?" in text and bool(_INSIDE.search(text))
    return bool(_RARE.search(text) or _RUN.search(text) or _INSIDE.search(text))


def tokens_of(line: str) -> list[str]:
    """Split at spaces and tabs only: other white space may be half of a garbled letter."""
    return re.split(r"[ \t\r]", line)


def strip_edges(token: str) -> str:
    """Without ASCII punctuation at the ends, but a question mark in front of a letter stays."""
    start = token.lstrip(_EDGE)
    if start != token and "?" in token[: len(token) - len(start)]:
        start = "?" + start if token[len(token) - len(start) - 1] == "?" else start
    return start.rstrip(_EDGE)


def skeleton(token: str) -> str:
    return _SPLIT.sub("", token).lower()


def neighbours(tokens: list[str], at: int) -> str:
    """What a token without letters or digits is known by: the words around it, and its place among its like."""
    before, k = "", 1
    for t in reversed(tokens[:at]):
        before = skeleton(t)
        if before:
            break
        k += 1
    after = next((x for t in tokens[at + 1 :] if (x := skeleton(t))), "")
    return f" {before} {after} {k}" if before and after else ""


def pieces(token: str) -> dict[int, str]:
    """What stands between the ASCII letters and digits, by the number of those before it."""
    out, at = {}, 0
    for part in re.split(r"([A-Za-z0-9]+)", token):
        if part and (part[0].isascii() and part[0].isalnum()):
            at += len(part)
        elif part:
            out[at] = part
    return out


def places(token: str) -> str:
    """Where pieces stand: only words whose pieces stand at the same places can be aligned."""
    return ",".join(map(str, pieces(token)))


def align(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """Pieces that differ between a word and its twin, or None where one of them has nothing to match."""
    g, c = pieces(garbled), pieces(clean)
    out = []
    for k in g.keys() | c.keys():
        if g.get(k) != c.get(k):
            if k not in g or k not in c:
                return None
            out.append((g[k], c[k]))
    return out or None


def _through(text: str, written: str, read: str) -> str | None:
    try:
        data = text.encode(written)
    except UnicodeEncodeError:
        return None
    out = []
    if written == "utf-8" or read not in ("utf-8",):
        for b in data:
            try:
                out.append(bytes([b]).decode(read))
            except UnicodeDecodeError:
                out.append(chr(b))  # readers keep undefined bytes as control characters
    return "".join(out)


def transformations() -> dict[tuple[str, str, int], dict[str, str]]:
    """Every way of garbling as a table clean character -> what it becomes (only characters that change)."""
    out = {}
    for w in WRITTEN:
        for r in READ:
            if w == r:
                continue
            for times in (1, 2) if w == "utf-8" else (1,):
                table = {}
                for c in LETTERS + MARKS + "ñáíóúãõåøìòÁÑ£§©®±²³µ½×":
                    g: str | None = c
                    for _ in range(times):
                        g = _through(g, w, r) if g is not None else None
                    if g is not None and g != c and not g.isascii():
                        table[c] = g
                if table:
                    out[w, r, times] = table
    return out


def infer(votes: dict[tuple[str, str], int], min_support: int = MIN_SUPPORT) -> tuple[dict[str, str], list[tuple[str, str, int]]]:
    """(garbled piece -> clean piece, the transformations accepted), from the votes of aligned pieces."""
    ways = transformations()
    left, accepted, table = dict(votes), [], {}
    while ways:
        # the way that explains most of what is still unexplained
        best, made, shown = None, {}, set()
        for name in sorted(ways):
            change = ways[name]
            got = {(g, c): n for (g, c), n in left.items() if "".join(change.get(x, x) for x in c) == g}
            if sum(got.values()) > sum(made.values()):
                best, made, shown = name, got, {x for _, c in got for x in c} & change.keys()
        if best is None or sum(made.values()) < min_support or len(shown) < 2:
            break
        accepted.append(best)
        for pair in made:
            left.pop(pair)
        for c, g in ways.pop(best).items():
            if g not in LETTERS and (len(g) > 1 or c in shown or g not in MARKS):
                table.setdefault(g, c)
    by_piece: dict[str, Counter] = defaultdict(Counter)
    for (g, c), n in votes.items():
        if LOST not in g and "?" not in g:
            by_piece[g][c] += n
    for g, c in by_piece.items():
        (clean, n), total = c.most_common(1)[0], sum(c.values())
        explained = "".join(table.get(x, x) for x in g) == clean
        if g not in table and g not in LETTERS and not explained and n >= min_support and n >= 0.8 * total:
            table[g] = clean
    return table, accepted


class Repair:
    """Applies learned mappings to words."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        many = sorted((g for g in table if len(g) > 1), key=lambda g: (-len(g), g))
        self.many = re.compile("|".join(map(re.escape, many))) if many else None
        # a single typographic mark stands for a letter only where a letter follows without a space before the mark's word
        one = [re.escape(g) for g in table if len(g) == 1 and g not in MARKS]
        mark = [re.escape(g) for g in table if len(g) == 1 and g in MARKS]
        parts = ([f"[{''.join(one)}]"] if one else []) + ([f"(?:(?<=[^\\W\\d_])|^)[{''.join(mark)}](?=[^\\W\\d_])"] if mark else [])
        self.one = re.compile("|".join(parts)) if parts else None

    def strong(self, token: str) -> bool:
        """Holds a piece of several characters that clean text doesn't have."""
        return bool(self.many and any(_RARE.search(m) or _RUN.search(m) for m in self.many.findall(token)))

    def word(self, token: str) -> str:
        found = False
        for _ in range(3):
            before = token
            if self.many:
                token = self.many.sub(lambda m: self.table[m.group()], token)
            if token == before:
                break
            found = True
        # single characters only in words that several characters don't explain
        return token if found or not self.one else self.one.sub(lambda m: self.table[m.group()], token)


def _quoted(tokens: list[str], at: int) -> bool:
    """A piece without ASCII letters that stands alone between quotation marks."""
    token = tokens[at].strip(".,;:!?()")
    if re.search(r"[A-Za-z0-9]", token):
        return False
    inner = token.strip(_QUOTES)
    if len(token) - len(inner) >= 2 and token[0] in _QUOTES and token[-1] in _QUOTES:
        return True
    before = tokens[at - 1] if at else ""
    after = tokens[at + 1] if at + 1 < len(tokens) else ""
    return before[-1:] in tuple("«“„`\"") and after[:1] in tuple("»”“`\"") and before[-1:] != "" and after[:1] != ""


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that may be garbled (kind ``s``) and counts of clean words (kind ``v``), in one pass."""
    fields = pa.schema([("kind", pa.string()), ("ext_id", pa.int64()), ("line_number", pa.int32()), ("line", pa.string()), ("skeleton", pa.string()), ("form", pa.string()), ("at", pa.string()), ("n", pa.int64())])

    def run(batches):
        clean: Counter = Counter()
        alone: Counter = Counter()
        known: dict[str, str | None] = {}

        def flush():
            rows = [(known[f], f, n) for f, n in clean.items() if known[f]] + [(key, f, n) for (key, f), n in alone.items()]
            nothing = [None] * len(rows)
            got = pa.RecordBatch.from_pydict({"kind": ["v"] * len(rows), "ext_id": nothing, "line_number": nothing, "line": nothing, "skeleton": [r[0] for r in rows], "form": [r[1] for r in rows], "at": [places(strip_edges(r[1])) for r in rows], "n": [r[2] for r in rows]}, schema=fields)
            clean.clear()
            alone.clear()
            known.clear()
            return got

        for b in batches:
            ids, numbers, lines = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t or i is None or t.isascii() and "?" not in t:
                    continue
                for k, line in enumerate(t.split("\n"), 1):
                    if suspicious(line):
                        ids.append(i)
                        numbers.append(k)
                        lines.append(line)
                    if not line.isascii():
                        parts = line.split(" ")
                        clean.update([w for w in parts if not w.isascii()])
                        if _ALONE.search(line):
                            for at, w in enumerate(parts):
                                if not w.isascii() and not skeleton(w) and (key := neighbours(parts, at)) and not suspicious(w):
                                    alone[key, w] += 1
            for f in clean.keys() - known.keys():
                s = strip_edges(f)
                known[f] = skeleton(s) if not suspicious(s) else None
            yield pa.RecordBatch.from_pydict({"kind": ["s"] * len(ids), "ext_id": ids, "line_number": numbers, "line": lines, "skeleton": [None] * len(ids), "form": [None] * len(ids), "at": [None] * len(ids), "n": [None] * len(ids)}, schema=fields)
            if len(clean) > 400_000:
                yield flush()
        yield flush()

    schema = "kind string, ext_id long, line_number int, line string, skeleton string, form string, at string, n long"
    rows = docs.select(F.col(id_col).cast("long").alias("ext_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    # forms are added up, lines pass (one of each): deliveries of the same line fall together here
    return rows.groupBy("kind", "ext_id", "line_number", "skeleton", "form", "at").agg(F.sum("n").alias("n"), F.max("line").alias("line"))


def garbled_lines(docs: DataFrame, id_col: str = "ext_id", text_col: str = "text", min_support: int = MIN_SUPPORT) -> DataFrame:
    """(ext_id, line_number, line, repaired, complete): garbled lines, counted from 1 and separated by line feeds, with
    their restored text; ``complete`` is false where something stays lost (then ``repaired`` holds the rest restored).

    Null ids and texts give nothing. Several deliveries of an id give each of their lines once. Columns other than the
    two named are not read.
    """
    scanned = cut_lineage(_scan(docs, id_col, text_col))
    lines = scanned.where("kind = 's'").select("ext_id", "line_number", "line")
    # clean words with one skeleton and the same places of pieces. A word without ASCII pieces is a twin of every garbled
    # one, and the best known twin is taken: words less known than such a one can't be it, all others stay
    known = scanned.where("kind = 'v' and n >= 2 and skeleton != ''").select("skeleton", "at", F.trim("form").alias("form"), "n")
    least = known.where(~F.col("form").rlike(_ASCII_PIECE)).groupBy("skeleton", "at").agg(F.max("n").alias("least"))
    vocabulary = known.join(least, ["skeleton", "at"], "left").where("least is null or n >= least").drop("least")

    token_fields = pa.schema([("ext_id", pa.int64()), ("line_number", pa.int32()), ("pos", pa.int32()), ("token", pa.string()), ("skeleton", pa.string()), ("at", pa.string()), ("quoted", pa.bool_())])

    def cut(given: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in token_fields.names}
        for i, k, line in zip(given["ext_id"], given["line_number"], given["line"], strict=True):
            parts = tokens_of(line)
            for p, t in enumerate(parts):
                s = "?" if t == "?" else strip_edges(t)
                if s and (suspicious(s) or s == "?"):
                    for n, v in zip(token_fields.names, (i, k, p, s, skeleton(s) or neighbours(parts, p), places(s), _quoted(parts, p)), strict=True):
                        out[n].append(v)
        return out

    tokens = cut_lineage(arrow_map(lines, cut, "ext_id long, line_number int, pos int, token string, skeleton string, at string, quoted boolean", token_fields))

    # near-twins: distinct garbled words with clean words of the same skeleton, best known first; what has no letters has
    # the words around it for a skeleton
    distinct = tokens.where("skeleton != ''").select("token", "skeleton", "at").distinct()
    twin_fields = pa.schema([("token", pa.string()), ("skeleton", pa.string()), ("form", pa.string()), ("n", pa.int64()), ("g", pa.list_(pa.string())), ("c", pa.list_(pa.string()))])

    def twin(given: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in twin_fields.names}
        for token, bone, form, n in zip(given["token"], given["skeleton"], given["form"], given["n"], strict=True):
            form = strip_edges(form)
            got = align(token, form)
            if got and all(not c.isascii() for _, c in got):
                for name, v in zip(twin_fields.names, (token, bone, form, n, [g for g, _ in got], [c for _, c in got]), strict=True):
                    out[name].append(v)
        return out

    twins = arrow_map(distinct.join(vocabulary, ["skeleton", "at"]).select("token", "skeleton", "form", "n"), twin, "token string, skeleton string, form string, n long, g array<string>, c array<string>", twin_fields)
    best = cut_lineage(twins.groupBy("token", "skeleton").agg(F.max_by(F.struct("form", "g", "c"), F.struct("n", "form")).alias("t"), F.sum("n").alias("n")).select("token", "skeleton", "t.*", "n"))

    votes = best.select(F.explode(F.arrays_zip("g", "c")).alias("p")).groupBy("p.g", "p.c").agg(F.count("*").alias("n")).where("n >= 2")
    voted = votes.limit(MAX_PIECES + 1).collect()
    if len(voted) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} different pieces")  # alphabets bound them far below
    table, _ = infer({(r.g, r.c): r.n for r in voted}, min_support)

    done_fields = pa.schema([("ext_id", pa.int64()), ("line_number", pa.int32()), ("pos", pa.int32()), ("token", pa.string()), ("to", pa.string()), ("sure", pa.bool_()), ("quoted", pa.bool_())])

    def decide(given: dict[str, list], repair: Repair) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in done_fields.names}
        for i, k, p, token, quoted, form in zip(*[given[n] for n in ("ext_id", "line_number", "pos", "token", "quoted", "form")], strict=True):
            to, sure = repair.word(token), False
            if not quoted:
                sure = bool(LOST in token or _C1.search(token) or repair.strong(token) or not skeleton(token) and to != token and _FOREIGN.search(token))
                if form is not None:
                    # the twin settles it if the learned mapping leads there, or if characters were lost
                    if to == form or LOST in token or "?" in token:
                        to, sure = form, True
            for n, v in zip(done_fields.names, (i, k, p, token, to, sure, quoted), strict=True):
                out[n].append(v)
        return out

    decided = arrow_map(tokens.join(best.select("token", "skeleton", "form"), ["token", "skeleton"], "left").select("ext_id", "line_number", "pos", "token", "quoted", "form"), decide, "ext_id long, line_number int, pos int, token string, to string, sure boolean, quoted boolean", done_fields, lambda: Repair(table))
    by_line = decided.groupBy("ext_id", "line_number").agg(F.max("sure").alias("sure"), F.collect_list(F.struct("pos", "token", "to", "sure", "quoted")).alias("words")).where("sure")  # a line's own words

    line_fields = pa.schema([("ext_id", pa.int64()), ("line_number", pa.int32()), ("line", pa.string()), ("repaired", pa.string()), ("complete", pa.bool_())])

    def rebuild(given: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in line_fields.names}
        for i, k, line, words in zip(given["ext_id"], given["line_number"], given["line"], given["words"], strict=True):
            parts = tokens_of(line)
            for w in words:
                # in a garbled line, names without a twin are put right too, where letters come out
                if w["sure"] or w["to"] != w["token"] and not _RARE.search(w["to"]) and not w["quoted"]:
                    parts[w["pos"]] = parts[w["pos"]].replace(w["token"], w["to"], 1)
            fixed = " ".join(parts)
            for n, v in zip(line_fields.names, (i, k, line, fixed, LOST not in fixed and not _C1.search(fixed) and not re.search(r"\w\?\w", fixed)), strict=True):
                out[n].append(v)
        return out

    return arrow_map(by_line.join(lines, ["ext_id", "line_number"]).select("ext_id", "line_number", "line", "words"), rebuild, "ext_id long, line_number int, line string, repaired string, complete boolean", line_fields)
