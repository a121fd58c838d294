"""A detector of the language of cleaned Latin text, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent short words of each language, of which few are words of another.
WORDS = {
    "de": "der die das und ist nicht ein eine mit ich wie auf für den von zu sich dass wenn werden kann wird oder aber bei".split(),
    "en": "the and is of to that it you for with this are not be have from what how when should which can was does but".split(),
    "es": "el los las una que por para con del como está cuando más pero esta muy donde porque sin sobre puede hace ser lo al".split(),
    "fr": "le les des une est pour dans que qui pas avec sur vous ce sont mais comment cette être nous plus fait ou du et".split(),
    "it": "il che di per una non con sono del della come più questo nel gli anche quando essere perché dei alla dopo cosa ho".split(),
    "pt": "o os uma não para com que por mais como está quando isso são mas também pelo você ao ser já seu num pode do".split(),
}


def _among(words: list[str]):
    return lambda t: t.isin(*words)


def detect(cleaned: Column) -> Column:
    """Code of the language most of whose frequent words occur in ``cleaned``, by occurrences; detection_error where none does.

    Ties go to the first code in order, so the same text has the same language on every run and executor. No Python runs.
    """
    tokens = F.split(F.lower(cleaned), " ")
    counts = F.array(*[F.struct(F.size(F.filter(tokens, _among(words))).alias("n"), F.lit(code).alias("code")) for code, words in WORDS.items()])
    best = F.aggregate(counts, F.struct(F.lit(0).alias("n"), F.lit("detection_error").alias("code")), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    return best["code"]
