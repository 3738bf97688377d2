"""Language by function words, and words that reduction must keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, any_of, col, let
from .text import fold_ascii

#: Common function words of each language, folded.  A parameter of everything that uses them.
STOPWORDS = {
    "fr": "le la les un une des du de et est sont que qui pour dans sur avec par pas ne ce cette ces mais ou donc en au aux se sa son ses leur tout plus il elle on nous vous je tu",
    "en": "the a an and or but if then that this these those of in on at to for with by from as is are was were be been have has had do does will would can could not it its you he she we they",
    "es": "el la los las un una de del y o que es son esta este en por para con sin sobre pero muy como cuando donde se su sus lo le al a ha han hay era fue ser todo no",
    "de": "der die das den dem des ein eine einen und oder aber ist sind war nicht mit von zu im in auf fur bei nach aus wie als auch nur noch wenn dass sich er sie es wir ihr ich man so",
}

#: Words that turn a statement round: reduction never drops them.
NEGATIONS = (
    "ne pas jamais rien aucun aucune personne ni sans plus "
    "not no never none nothing nor neither without "
    "nunca nada ningun ninguna nadie tampoco "
    "nicht nie nichts kein keine keinen niemals ohne"
).split()


def words_of(languages: dict[str, str] | None = None, lang: str | None = None) -> list[str]:
    """Stopwords of a language, or of all together."""
    lists = languages or STOPWORDS
    own = lists[lang].split() if lang in lists else " ".join(lists.values()).split()
    return list(dict.fromkeys(own))


def stopword_counts(c: ColumnOrName, languages: dict[str, str] | None = None) -> Column:
    """Struct with the number of each language's stopwords in a text."""
    lists = languages or STOPWORDS
    found = F.regexp_extract_all(fold_ascii(F.lower(col(c))), F.lit("([a-z']+)"), F.lit(1))

    def hits(a: Column, own: list[str]) -> Column:
        return F.size(F.filter(a, lambda w: w.isin(*own))).cast("bigint")

    return let(found, lambda a: F.struct(*(hits(a, s.split()).alias(lang) for lang, s in lists.items())))


def detect_language(c: ColumnOrName, least_chars: int = 40, languages: dict[str, str] | None = None) -> Column:
    """The language with over 1.5 times as many stopwords as the next, else ``mixed``; ``unknown`` for
    short texts and those without stopwords.  Accents count as one word of French."""
    lists = languages or STOPWORDS
    text = col(c)
    accent = F.when(text.rlike("(?iu)[àâäéèêëîïôöùûüçœæ]"), 1).otherwise(0)

    def pick(n: Column) -> Column:
        rows = F.array(*(F.struct((-(n[lang] + (accent if lang == "fr" else 0))).alias("n"), F.lit(i).alias("i"), F.lit(lang).alias("lang")) for i, lang in enumerate(lists)))
        ranked = F.array_sort(rows)

        def top(r: Column) -> Column:
            first, second = F.element_at(r, 1), F.element_at(r, 2)
            return F.when(first["n"] == 0, "unknown").when(-first["n"] > -second["n"] * 1.5, first["lang"]).otherwise("mixed")

        return let(ranked, top)

    return F.when(text.isNull() | (F.length(text) < least_chars), "unknown").otherwise(let(stopword_counts(text, lists), pick))


#: Numbers, hashes, flags, acronyms, file names, compounds, camel case, words with digits.
PROTECTED = [
    r"^[0-9.,%$€£-]+$",
    r"(?i)^[a-f0-9]{6,}$",
    r"(?i)^0x[0-9a-f]+$",
    r"(?i)^--?[a-z][a-z0-9-]*$",
    r"^[A-Z]{2,}$",
    r"(?i)\.[a-z0-9]{1,6}$",
    r"(?i)^[a-z0-9]+([_-][a-z0-9]+)+$",
    r"^[A-Za-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]+$",
    r"(?i)^[a-z0-9]*[0-9][a-z0-9]*$",
]


def is_protected(c: ColumnOrName) -> Column:
    return any_of(col(c), PROTECTED)
