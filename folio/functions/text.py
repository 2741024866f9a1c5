"""Text normalisation, relevance and masking as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of the filters, acronyms that a mask of names keeps.
TRUTHY = ["true", "1", "sim", "x", "verdadeiro"]
KEPT = ["BC", "BCB", "Copom", "Selic", "IPCA", "IPCA-15", "IGP-M", "PIB", "Focus", "Fed", "Tesouro", "Banco Central", "Banco Central do Brasil", "CMN", "Fazenda", "Congresso", "Planalto", "Executivo", "Bolsa", "Ibovespa", "B3", "DI", "CDI", "FMI", "EUA"]


def _one_letter(c: str) -> str | None:
    """The character that compatibility decomposition without combining marks leaves of c, if it is one."""
    rest = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
    return rest[0] if len(rest) == 1 else None


#: Letters and signs with marks that become one character, and that character. Built from the rule.
MARKED = "".join(c for c in map(chr, (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028))) if _one_letter(c) not in (None, c))
PLAIN = "".join(_one_letter(c) for c in MARKED)
_BEYOND = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    drop = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return texts.map(lambda t: drop(t) if t is not None and not t.isascii() else t)


def unmarked(col: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks.

    Texts of ASCII stay, those of which a table of Latin letters leaves ASCII go by it; only others are sent to Python, in batches."""
    by_table = F.when(col.rlike(_BEYOND), F.translate(col, MARKED, PLAIN)).otherwise(col)
    other = by_table.rlike(_BEYOND)
    return F.when(other, _decomposed(F.when(other, col))).otherwise(by_table)


def norm(col: Column) -> Column:
    """Lower case, without marks."""
    return unmarked(F.lower(col))


def title_key(col: Column) -> Column:
    """Anything but letters, digits and spaces becomes a space; spaces stay as they are."""
    return title_key_of(norm(col))


def title_key_of(normed: Column) -> Column:
    return F.regexp_replace(normed, r"[^a-z0-9 ]", " ")


def text_key(col: Column) -> Column:
    """As title_key, after dropping what isn't ASCII, with single spaces and none at the ends."""
    return text_key_of(unmarked(col))


def text_key_of(bare: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(bare, r"[^\x00-\x7F]", "")), r"[^a-z0-9]+", " "))


def text_hash(*cols: Column) -> Column:
    """16 hex digits that agree for texts with equal keys; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(text_key(F.coalesce(c, F.lit(""))) for c in cols))), 1, 16)


def slug(col: Column, size: int = 80) -> Column:
    return slug_of(norm(col), size)


def slug_of(normed: Column, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(normed, r"[^a-z0-9]+", "-"), r"^-|-$", ""), 1, size)


def has_term(cols: Sequence[Column], terms: Sequence[str]) -> Column:
    """Whether one of the unmarked terms is in the texts, however marked; nulls are empty."""
    return norm(F.concat_ws(" ", *cols)).rlike("|".join(terms))


def relevant(col: Column, include: str, exclude: str) -> Column:
    """Matches include, not exclude; letters with marks are letters in both."""
    return col.rlike("(?iu)" + include) & ~col.rlike("(?iu)" + exclude)


def slug_relevant(col: Column, parts: Sequence[str], tokens: Sequence[str]) -> Column:
    """One of the parts anywhere in the slug, or one of the tokens between its hyphens."""
    return col.rlike("|".join(parts)) | F.arrays_overlap(F.split(col, "-"), F.array(*map(F.lit, tokens)))


def number(col: Column) -> Column:
    """Points group thousands, the comma is decimal; with an exponent points are decimal too; null for anything else."""
    bare = F.trim(col)
    grouped = F.when(F.upper(bare).contains("E"), bare).otherwise(F.replace(bare, F.lit("."), F.lit("")))
    return F.replace(grouped, F.lit(","), F.lit(".")).try_cast("double")


def truthy(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col)).isin(TRUTHY), F.lit(False))


def joined_blocks(*cols: Column, sep: str = "\n") -> Column:
    """The non-null blocks in order."""
    return F.concat_ws(sep, *cols)


def paragraphs(col: Column, least: int = 60) -> Column:
    """Trimmed lines of at least so many characters."""
    return F.filter(F.transform(F.split(col, "\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def without_repeated_lead(items: Column, lead: Column, size: int = 80) -> Column:
    """Paragraphs without the first, if its normal form begins with the first `size` characters of the lead's."""
    start = F.substring(norm(lead), 1, size)
    again = (F.size(items) > 0) & (start != "") & F.substring(norm(F.get(items, 0)), 1, size).eqNullSafe(start)
    return F.when(again, F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1)))).otherwise(items)


def regrouped_sentences(col: Column, least: int = 220) -> Column:
    """Sentences put together, in order, to paragraphs of at least so many characters; the last may be shorter."""
    sentences = F.split(col, r"(?<=[.!?]) +")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        grown = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        full = F.length(grown) >= least
        return F.struct(F.when(full, F.array_append(acc["done"], grown)).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(grown).alias("open"))

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def html_paragraphs(col: Column, least: int = 60) -> Column:
    """Texts of p elements without tags and common entities, of at least so many characters."""
    raw = F.regexp_extract_all(col, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1)
    plain = F.transform(raw, lambda p: F.trim(F.regexp_replace(unescaped(F.regexp_replace(p, r"<[^>]*>", "")), r"\s+", " ")))
    return F.filter(plain, lambda p: F.length(p) >= least)


def unescaped(col: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def without_prefix(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, "(?iu)^" + pattern, "")


def clean_body(col: Column) -> Column:
    """Without lines that credit a picture, with single spaces."""
    bare = F.regexp_replace(col, r"(?im)^\s*(foto|imagem|credito|crédito|legenda)\s*:.*$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


# Months, what a level's number looks like, the indicators and their marks, any number, a name within a sentence.
MONTHS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
LEVEL = r"(?:R\$\s*)?\d{1,3}(?:\.\d{3})*(?:,\d+)?(?:\s*%|\s*pontos?(?:\s*percentuais)?)?"
INDICATORS = [("selic", "[SELIC_NIVEL]"), ("ipca", "[IPCA_NIVEL]"), ("(?:d[óo]lar|c[âa]mbio)", "[CAMBIO_NIVEL]"), ("(?:pib|produto interno bruto)", "[PIB_NIVEL]")]
NUMBER = r"(?:R\$\s*)?\d[\d.,]*(?:\s*%|\s*pontos?(?:\s*percentuais)?|\s*p\.p\.)?"
NAME = r"(?<=[a-zà-ú0-9,;:)\]] )(?:[A-ZÀ-Ú][\wà-ú]+|[A-Z]{2,})(?:\s+(?:de|da|do|dos|das|e)?\s*[A-ZÀ-Ú][\wà-ú]+)*"


def _any_of(names: Sequence[str], capitals: bool = False) -> list[str]:
    """Patterns for the names, longest first: one for all, or one each where one name's end is another's beginning, as then the
    order of replacing matters. capitals: also in capitals throughout."""
    ordered = sorted(dict.fromkeys(names), key=lambda n: -len(n))
    meet = any(a != b and any(b.startswith(a[i:]) for i in range(1, len(a))) for a in ordered for b in ordered)
    each = ["|".join(dict.fromkeys([re.escape(n), *([re.escape(n.upper())] if capitals else [])])) for n in ordered]
    return each if meet else ["|".join(each)] if each else []


def masked(col: Column, level: int, officials: Sequence[str] = (), politicians: Sequence[str] = (), era: Sequence[str] = ()) -> Column:
    """Masks that build on each other: 1 dates, 2 officials, 3 politicians, 4 the levels of indicators, 5 words of an era, all numbers,
    and capitalised names within a sentence but for KEPT. Names match as they are written or in capitals. Null is an empty text."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), rf"(?iU)\b(?:19|20)\d{{2}}\b|\b\d{{1,2}} de (?:{MONTHS})\b", "[DATA]")
    for least, names, mark in ((2, officials, "[AUTORIDADE_BC]"), (3, politicians, "[POLITICO]")):
        for pattern in _any_of(names, capitals=True) if level >= least else []:
            out = F.regexp_replace(out, rf"(?U)\b(?:{pattern})\b", mark)
    for word, mark in INDICATORS if level >= 4 else []:
        out = F.regexp_replace(out, rf"(?iU)(\b{word}\b\D{{0,20}}?){LEVEL}", f"$1{mark}")
    if level >= 5:
        if era:
            ordered = "|".join(re.escape(n) for n in sorted(era, key=lambda n: -len(n)))
            out = F.regexp_replace(out, rf"(?iU)\b(?:{ordered})\b", "[EPOCA]")
        out = F.regexp_replace(out, f"(?U){NUMBER}", "[NUM]")
        # what is a name is set between two characters that no text has, then kept or masked
        out = F.regexp_replace(F.translate(out, "\x01\x02", ""), f"(?U){NAME}", "\x01$0\x02")
        out = F.regexp_replace(out, f"\x01({'|'.join(map(re.escape, KEPT))})\x02", "$1")
        out = F.regexp_replace(out, "\x01[^\x02]*\x02", "[NOME]")
    return out
