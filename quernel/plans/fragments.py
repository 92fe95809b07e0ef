"""SQL fragments of the checks: the same definitions as in ``quernel.functions``, for DuckDB."""

from __future__ import annotations

from ..functions import language as L

SP = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def casefold(c: str) -> str:
    return f"replace(replace(lower(replace({c}, 'İ', 'i̇')), 'ß', 'ss'), 'ς', 'σ')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SP}+', ' ', 'g'))"


def key(c: str) -> str:
    return squeeze(casefold(f"nfc_normalize({c})"))


def lines(c: str) -> str:
    return f"string_split_regex(regexp_replace({c}, '(?:{BREAK})$', ''), '{BREAK}')"


def ends(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def kept_lines(c: str) -> str:
    return f"list_filter(list_transform({lines(c)}, lambda x: {ends('x')}), lambda x: x != '')"


def count(c: str, keep: str) -> str:
    return f"length(regexp_replace({c}, '[^{keep}]', '', 'g'))"


def found(c: str, pattern: str) -> str:
    return f"regexp_extract_all({c}, '{pattern}')"


def words(c: str, pattern: str = r"[\p{L}\p{N}_]+") -> str:
    return found(casefold(c), pattern)


def member(w: str, wanted) -> str:
    return f"list_contains([{', '.join(chr(39) + x + chr(39) for x in wanted)}], {w})"


def hits(ws: str, wanted) -> str:
    return f"len(list_filter({ws}, lambda w: {member('w', wanted)}))"


def any_of(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def folded_words(c: str, pattern: str) -> str:
    return f"list_transform({found(c, pattern)}, lambda x: {casefold('x')})"


def language_a(c: str) -> str:
    w = folded_words(c, "[A-Za-zÇĞİÖŞÜçğıöşü]+")
    tr = f"(2 * {count(c, L.A_CHARS)} + {hits(w, L.A_TR)})"
    en = f"({hits(w, L.A_EN)} + CASE WHEN {count(c, 'A-Za-z')} > 0 AND {count(c, L.A_CHARS)} = 0 THEN 1 ELSE 0 END)"
    return f"CASE WHEN len({w}) = 0 THEN 'unknown' WHEN {tr} > {en} THEN 'tr' WHEN {en} > {tr} THEN 'en' ELSE 'unknown' END"


def language_b(c: str) -> tuple[str, str]:
    w = folded_words(c, r"\p{L}+")
    tr = f"(2 * {hits(w, L.B_TR)} + least(20, {count(c, L.B_CHARS)}))"
    en = f"(2 * {hits(w, L.B_EN)})"
    share = f"({count(c, 'A-Za-z')}::DOUBLE / {count(c, chr(92) + 'p{L}')})"
    label = f"CASE WHEN len({w}) = 0 THEN 'unknown' WHEN {tr} = 0 AND {en} = 0 THEN CASE WHEN {share} >= 0.97 THEN 'en' ELSE 'unknown' END WHEN {tr} > {en} THEN 'tr' WHEN {en} > {tr} THEN 'en' ELSE 'unknown' END"
    conf = f"CASE WHEN len({w}) = 0 THEN 0.0 WHEN {tr} = 0 AND {en} = 0 THEN CASE WHEN {share} >= 0.97 THEN 0.55 ELSE 0.0 END WHEN {tr} = {en} THEN 0.5 ELSE greatest({tr}, {en})::DOUBLE / ({tr} + {en}) END"
    return label, conf


def language_c(c: str) -> str:
    w = folded_words(c, r"[\p{L}\p{N}_]+")
    tr, en = f"(2 * {count(c, L.A_CHARS)} + {hits(w, L.C_TR)})", f"{hits(w, L.C_EN)}"
    return rf"CASE WHEN NOT regexp_matches({c}, '[^\x00-\x20]') THEN 'unknown' WHEN {tr} > {en} THEN 'tr' WHEN {en} > {tr} THEN 'en' WHEN NOT regexp_matches({c}, '[^\x00-\x7F]') THEN 'en' ELSE 'unknown' END"


def language_d(c: str, fallback: str) -> str:
    w = f"list_distinct({folded_words(c, chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')})"
    return f"CASE WHEN {fallback} = 'code' THEN 'code' WHEN {count(c, L.D_CHARS)} > 0 OR {hits(w, L.D_TR)} >= 2 THEN 'tr' WHEN {hits(w, L.D_EN)} >= 2 THEN 'en' ELSE {fallback} END"


def shingled(tokens: str, k: int) -> str:
    """Joined runs of k tokens of a list expression; one run of all where there are fewer."""
    return f"CASE WHEN len({tokens}) = 0 THEN []::VARCHAR[] ELSE list_transform(range(1, greatest(len({tokens}) - {k} + 1, 1) + 1), lambda i: array_to_string({tokens}[i : i + {k} - 1], ' ')) END"


def hash_bucket(expr: str, buckets: int) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 16))::UBIGINT % {buckets})::INTEGER"
