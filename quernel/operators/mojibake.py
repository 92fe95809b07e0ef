"""Findings of broken characters with severity and a guessed repair."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known breakages and what they were, in order, and what broken clusters look like.
REPAIRS = {
    "TÃ¼rkiye": "Türkiye", "TÃƒÂ¼rkiye": "Türkiye", "KullanÃ„Â±cÃ„Â±": "Kullanıcı", "KullanÄ±cÄ±": "Kullanıcı", "GÃ¼venlik": "Güvenlik", "GÃƒÂ¼venlik": "Güvenlik",
    "Ã§": "ç", "ÃƒÂ§": "ç", "Ã¶": "ö", "ÃƒÂ¶": "ö", "Ã¼": "ü", "ÃƒÂ¼": "ü", "Ã„Â±": "ı", "Ä±": "ı", "Ã…Å¸": "ş", "ÅŸ": "ş",
}
MARKERS = ("Ã", "Â", "Ä", "Å", "â€", "ï¿½")
CLUSTER = r"(?:Ã.|Â.|Ä.|Å.|â€[^\s]*|ï¿½)+"
REPEATED = r"(?:Ã.|Â.|Ä.|Å.){2,}"
_CLUSTER, _REPEATED = re.compile(CLUSTER), re.compile(REPEATED)


def _broken(text: str) -> bool:
    return "�" in text or any(m in text for m in MARKERS)


def guess(text: str) -> str | None:
    """What a text was before it was written as UTF-8 and read as Latin-1 or Windows-1252, up to three times over; null
    where it can't have been."""
    for _ in range(3):
        for codec in ("latin-1", "cp1252"):
            try:
                before = text.encode(codec).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            return None
        if before == text:
            return None
        text = before
        if not _broken(text):
            break
    return text


def findings(docs: DataFrame, id_col: str = "ext_id", text_col: str = "text") -> DataFrame:
    """(id, line_number, substring, original, severity, safe): each broken substring once per line, in the order of the
    kinds: replacement characters (critical), known breakages, repeated clusters (high), clusters (medium where a repair
    is found). Lines are numbered from 1 and separated by line feeds. Null ids and texts give nothing."""
    fields = pa.schema([(id_col, pa.int64()), ("line_number", pa.int32()), ("substring", pa.string()), ("original", pa.string()), ("severity", pa.string()), ("safe", pa.bool_())])

    def of_line(line: str):
        seen: dict[str, tuple[str | None, str]] = {}
        if "�" in line:
            seen["�"] = (None, "critical")
        for broken, was in REPAIRS.items():
            if broken in line:
                seen.setdefault(broken, (was, "high"))
        for pattern in (_REPEATED, _CLUSTER):
            for s in pattern.findall(line):
                if s not in seen:
                    was = (REPAIRS.get(s) if pattern is _CLUSTER else None) or guess(s)
                    seen[s] = (was, "medium" if was and pattern is _CLUSTER else "high")
        return seen

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, line in enumerate(t.split("\n"), 1):
                    if _broken(line):
                        out += [(i, k, s, was, severity, was is not None) for s, (was, severity) in of_line(line).items()]
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in out] for j, n in enumerate(fields.names)}, schema=fields)

    may = F.col(text_col).rlike("�|" + "|".join(MARKERS))  # other texts stay in the JVM
    return docs.where(may & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, line_number int, substring string, original string, severity string, safe boolean").distinct()
