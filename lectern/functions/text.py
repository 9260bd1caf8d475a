"""Text measures of transcript segments as column expressions. Scores are whole thousandths, computed from
counts in integers, so that they are the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker words and phrases, stop words, continuation words.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "и", "в", "во", "на", "с", "со", "за", "под", "над", "из", "от", "до", "по",
    "для", "при", "через", "между", "к", "у", "о", "об", "без", "это", "что", "как", "так", "же", "ли", "бы", "мне",
    "тебе", "себе",
]
DEFINITION_EN = ["refers to", "means", "defined as", "definition of", "in other words", "that is", "namely", "essentially"]
DEFINITION_RU = ["это", "называется", "представляет собой", "является", "означает", "определяется как", "можно определить как", "по сути", "другими словами", "то есть", "а именно"]
RHETORICAL_EN = ["why", "how", "what", "where", "when", "which", "who", "note that", "important", "key", "crucial", "main"]
RHETORICAL_RU = ["почему", "как", "что", "где", "когда", "какой", "зачем", "обратите внимание", "важно", "ключевой", "главный"]
PRONOUNS_EN = [
    "it", "they", "them", "he", "she", "his", "her", "their", "its", "that", "this", "these", "those", "such",
]
PRONOUNS_RU = [
    "он", "она", "оно", "они", "его", "её", "их", "ему", "ей", "им", "ним", "ней", "тот", "эта", "это", "эти",
    "такой", "такая", "такое", "такие",
]
CONTINUATION_WORDS = [
    "и", "а", "но", "поэтому", "причем", "причём", "соответственно", "тоже", "также", "он", "она", "оно", "они",
    "его", "её", "ее", "их", "нет", "да", "and", "but", "so", "no", "yes",
]
CONTINUATION_PHRASES = ["то есть", "потому что", "так что", "при этом", "кроме того", "тем самым", "вот это", "в том числе", "that is", "because"]
SENTENCE_ENDS = [".", "!", "?", "…", "»", '"']

WORD = r"[\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def words(lower: Column) -> Column:
    """The tokens of a text in lower case."""
    return F.regexp_extract_all(lower, F.lit(f"{WORD}+"), 0)


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def language(text: Column) -> Column:
    """ru if more than half of the letters are Cyrillic (capital Ё is not counted), unknown without letters."""
    return F.when(~text.rlike(r"\p{L}"), "unknown").when(is_russian(text), "ru").otherwise("en")


def is_russian(text: Column) -> Column:
    """More than half of the letters are Cyrillic. Letters are counted only where any is Cyrillic."""
    cyrillic = F.regexp_count(text, F.lit("[а-яА-Яё]"))
    return text.rlike("[а-яА-Яё]") & (cyrillic * 2 > F.regexp_count(text, F.lit(r"\p{L}")))


def phrase_pattern(phrase: str) -> str:
    """The phrase's words with white space between them, bounded by anything but word characters."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){phrase.replace(' ', chr(92) + 's+')}($|[^\p{{L}}\p{{N}}_])"


def _present(lower: Column, words: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur. Whether a phrase's words stand anywhere is seen before its pattern is tried."""
    single = [p for p in phrases if " " not in p]
    count = F.size(F.array_intersect(words, F.array(*[F.lit(p) for p in single])))
    for p in phrases:
        if " " in p:
            here = lower.rlike(phrase_pattern(p))
            for w in sorted(p.split(), key=len):
                here = lower.contains(w) & here
            count = count + here.cast("int")
    return count


def definition_quarters(lower: Column, words: Column, russian: Column) -> Column:
    """Definition score in quarters: none 0, one 2, then one more for each marker up to 4. lower: the text in lower
    case, words: its tokens, russian: is_russian, each computed once for a segment."""
    copula = sum((lower.contains(w) & lower.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){w}\s+{WORD}")).cast("int") for w in ("is", "are"))
    n = F.when(russian, _present(lower, words, DEFINITION_RU)).otherwise(_present(lower, words, DEFINITION_EN) + copula)
    return F.when(n == 0, 0).otherwise(F.least(F.lit(4), n + 1))


def rhetorical_hundredths(lower: Column, words: Column, russian: Column) -> Column:
    """Rhetorical score in hundredths: 15 for each marker up to 70 (a question mark is one), 30 for a question."""
    question = lower.contains("?").cast("int")
    n = question + F.when(russian, _present(lower, words, RHETORICAL_RU)).otherwise(_present(lower, words, RHETORICAL_EN))
    return F.least(F.lit(100), F.least(F.lit(70), n * 15) + question * 30)


def pronoun_count(words: Column, russian: Column) -> Column:
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    return F.when(russian, count(PRONOUNS_RU)).otherwise(count(PRONOUNS_EN))


def starts_sentence(text: Column) -> Column:
    """The first letter is not a lower-case one."""
    return ~F.regexp_extract(text, r"^[^\p{L}]*(\p{L})", 1).rlike(r"^\p{Ll}")


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(r'[.!?…»"]$')


def is_continuation(text: Column) -> Column:
    """Opens with a word or phrase that refers back."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)
    opening = F.array_join(F.slice(words, 1, 3), " ")
    phrase = F.lit(False)
    for p in CONTINUATION_PHRASES:
        phrase = phrase | opening.startswith(p)
    return F.coalesce(F.get(words, F.lit(0)).isin(CONTINUATION_WORDS), F.lit(False)) | phrase


def clock(ms: Column, hours: Column) -> Column:
    """H:MM:SS, or MM:SS where hours is false; fractions are cut off."""
    s = F.floor(ms / 1000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(hours, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))).otherwise(
        F.concat(F.when(s < 6000, two(F.floor(s / 60))).otherwise(F.floor(s / 60).cast("string")), F.lit(":"), two(s % 60))
    )
