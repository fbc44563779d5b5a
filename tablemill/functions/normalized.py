"""Text without case, accents and marks between words, on the driver and on columns.

`normalize_text` is the definition. `normalized` is the same in native expressions: characters are
decomposed for compatibility by tables that are worked out once from the Unicode data at hand. What becomes one
character, or none, is one `translate`; what becomes several is taken apart only in texts that hold such a
character; Hangul syllables are taken apart by arithmetic. ASCII texts skip all of that.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations in headers.
ABBREVIATIONS = {
    "cod": "codigo", "desc": "descricao", "dt": "data", "end": "endereco", "nasc": "nascimento", "no": "numero", "nro": "numero",
    "num": "numero", "obs": "observacao", "qtd": "quantidade", "ref": "referencia", "tel": "telefone", "vlr": "valor",
}
#: Hangul syllables: the first, their number, and the number of those with one first and with one middle letter.
HANGUL, SYLLABLES, PER_FIRST, PER_MIDDLE = 0xAC00, 11_172, 588, 28
FIRSTS, MIDDLES, LASTS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
#: Its small form depends on what follows, so that is left to lower().
SIGMA = "Σ"
#: Characters that become more than so many are few, and looked at apart.
FEW = 3


def is_mark(c: str) -> bool:
    return unicodedata.category(c).startswith("M")


def normalize_text(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not is_mark(c))
    words = re.sub(r"[\W_]+", " ", bare.lower()).split()
    return " ".join(ABBREVIATIONS.get(w, w) for w in words)


@dataclass(frozen=True)
class Tables:
    #: Characters that become one, and those; then, in `one_from` alone, characters that vanish.
    one_from: str
    one_to: str
    #: Characters that become up to FEW, and more; the longest first.
    few: tuple[tuple[str, str], ...]
    many: tuple[tuple[str, str], ...]
    #: Letters and numbers beyond ASCII as ranges of a pattern.
    words: str


@lru_cache(1)
def tables() -> Tables:
    one, none, several, ranges = [], [], [], []
    for code in range(0x80, 0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind[0] in "LN" or c.isalnum():
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
        if HANGUL <= code < HANGUL + SYLLABLES:
            continue
        bare = "".join(x if x == SIGMA else x.lower() for x in unicodedata.normalize("NFKD", c) if not is_mark(x))
        if not bare:
            none.append(c)
        elif len(bare) > 1:
            several.append((c, bare))
        elif bare != c:
            one.append((c, bare))
    several.sort(key=lambda x: -len(x[1]))
    split = next((i for i, x in enumerate(several) if len(x[1]) <= FEW), len(several))
    words = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return Tables("".join(c for c, _ in one) + "".join(none), "".join(b for _, b in one), tuple(several[split:]), tuple(several[:split]), words)


def several_of(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """What a character of the table becomes: its first, second, ... part each by one translation, which drops those
    that have no such part."""
    found = "".join(x for x, _ in table)
    parts = [F.translate(c, found, "".join(b[k] for _, b in table if len(b) > k)) for k in range(len(table[0][1]))]
    return F.concat(*parts)


def in_table(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """text without the table's characters."""
    return F.translate(text, "".join(c for c, _ in table), "")


def syllable(c: Column) -> Column:
    """The letters of a Hangul syllable."""
    n = F.ascii(c) - HANGUL
    last = n % PER_MIDDLE
    at = lambda letters, i: F.substr(F.lit(letters), i + 1, F.lit(1))
    return F.concat(at(FIRSTS, F.floor(n / PER_FIRST)), at(MIDDLES, F.floor(n % PER_FIRST / PER_MIDDLE)), F.when(last > 0, at(LASTS, last - 1)).otherwise(""))


def decomposed(text: Column) -> Column:
    """Compatibility decomposition without marks, in lower case but for SIGMA."""
    t = tables()
    hangul = f"[\\x{{{HANGUL:x}}}-\\x{{{HANGUL + SYLLABLES - 1:x}}}]"
    apart = lambda c: F.when(in_table(c, t.few) == "", several_of(c, t.few)).when(in_table(c, t.many) == "", several_of(c, t.many)).when(c.rlike(hangul), syllable(c)).otherwise(c)
    whole = F.array_join(F.transform(F.split(text, ""), apart), "")
    long = text.rlike(hangul) | (in_table(text, t.few) != text) | (in_table(text, t.many) != text)
    return F.translate(F.when(long, whole).otherwise(text), t.one_from, t.one_to)


def normalized(text: Column) -> Column:
    """normalize_text on a column; null stays null."""
    ascii_ = F.octet_length(text) == F.length(text)
    plain = F.lower(F.when(ascii_, text).otherwise(decomposed(text)))
    words = F.split(F.regexp_replace(plain, f"(?:[\\x00-/:-@\\[-`{{-\\x7f]|[^\\x00-\\x7f\\p{{L}}\\p{{N}}{tables().words}])+", " "), " ")
    short = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")
