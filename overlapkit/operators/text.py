"""Corpus text cleaning with an audit trail, and languages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapkit.functions import collapse_newlines, normalize_spaces, trim_unicode

# Filler words by language, in the order in which they are removed. The last one begins with
# a space, so the character before that space decides whether it stands alone.
FILLERS = {
    "en": ["uhm", "uh", "um", "erm", "er", "like", "you know", "so like"],
    "de": ["ähm", "äh", "hm", "na ja", "also", "wie soll ich sagen"],
    "fr": ["euh", "ben", "alors", "donc", "en fait", "vous savez"],
    "vi": ["ừm", "ờ", "uhm", "thì", " kiểu như"],
}
# Fillers that are words of their own as well.
REAL_WORDS = {"like", "so like", "also", "alors", "donc", "thì"}
# Primary language subtags that have a code (their own), and those that the second kind of model takes.
LANGUAGES = [
    "bg", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "hr", "hu", "it", "ja", "ko", "lt", "lv", "mt", "nl", "pl", "pt", "ro", "ru", "sk", "sl", "sv", "uk", "vi", "zh",
]
MODEL_LANGUAGES = [
    "bg", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "hr", "hu", "it", "lt", "lv", "mt", "nl", "pl", "pt", "ro", "ru", "sk", "sl", "sv", "uk",
]


def fillers(conservative: bool = False) -> dict[str, list[str]]:
    """The default dictionaries; ``conservative`` leaves out real words."""
    return {lang: [w for w in words if not (conservative and w in REAL_WORDS)] for lang, words in FILLERS.items()}


def filler_pattern(word: str) -> str:
    """A filler as a whole word in any case, with one space after it; digits and "_" bound a word."""
    return rf"(?iu)(?<!\p{{IsAlphabetic}}){re.escape(word)}(?!\p{{IsAlphabetic}}) ?"


def _by_language(text: Column, lang: Column, dictionary: dict[str, list[str]]) -> Column:
    out: Column | None = None
    for code, words in dictionary.items():
        cleaned = text
        for w in words:
            cleaned = F.regexp_replace(cleaned, filler_pattern(w), "")
        out = F.when(lang == code, cleaned) if out is None else out.when(lang == code, cleaned)
    return text if out is None else out.otherwise(text)


def remove_fillers(df: DataFrame, text: str, lang: str, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Each filler of the row's language removed, in the dictionary's order; other languages untouched."""
    return df.withColumn(text, _by_language(F.col(text), F.col(lang), fillers() if dictionary is None else dictionary))


def clean_corpus(df: DataFrame, text: str, lang: str, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Fillers out, newlines collapsed, spaces normalized, ends trimmed: one projection."""
    cleaned = _by_language(F.col(text), F.col(lang), fillers() if dictionary is None else dictionary)
    return df.withColumn(text, trim_unicode(normalize_spaces(collapse_newlines(cleaned))))


def filler_report(df: DataFrame, text: str, lang: str, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """(lang, filler, removed, documents, chars): what cleaning removes, filler by filler.

    Each filler is counted in the text that those before it have left.
    """
    dictionary = fillers() if dictionary is None else dictionary
    t, rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("_left")), []
    for k in range(max(map(len, dictionary.values()), default=0)):
        # columns of their own, one a step, so that no text is cleaned twice
        here = {code: words[k] for code, words in dictionary.items() if k < len(words)}
        pick = lambda of: F.coalesce(*[F.when(F.col("lang") == code, of(w)) for code, w in here.items()])  # noqa: B023, E731
        t = t.withColumn("_after", pick(lambda w: F.regexp_replace("_left", filler_pattern(w), "")))
        n = pick(lambda w: F.regexp_count("_left", F.lit(filler_pattern(w))))
        t = t.withColumn(f"_r{k}", F.struct(pick(F.lit).alias("filler"), n.alias("n"), (F.length("_left") - F.length("_after")).alias("chars")))
        t = t.withColumn("_left", F.col("_after")).drop("_after")
        rows.append(f"_r{k}")
    rows = t.select("lang", F.explode(F.array(*rows)).alias("r")).where("r.n > 0")
    return rows.groupBy("lang", F.col("r.filler").alias("filler")).agg(
        F.sum("r.n").cast("long").alias("removed"), F.count("*").alias("documents"), F.sum("r.chars").cast("long").alias("chars")
    )


def is_blank(text: Column) -> Column:
    return F.coalesce(trim_unicode(text) == "", F.lit(True))


def split_blank(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows to deliver, blank rows): null, empty or white space alone is never delivered."""
    return df.where(~is_blank(F.col(text))), df.where(is_blank(F.col(text)))


def map_language(df: DataFrame, tag: str, codes: list[str] | None = None) -> DataFrame:
    """``mapped`` (the tag's primary subtag if it has a code, else null) and ``language`` ("und" for null)."""
    primary = F.split_part(F.col(tag), F.lit("-"), F.lit(1))
    mapped = F.when(primary.isin(codes or LANGUAGES), primary)
    return df.withColumn("mapped", mapped).withColumn("language", F.coalesce(mapped, F.lit("und")))


def reachable_languages(models: DataFrame, accepted: DataFrame, codes: DataFrame) -> DataFrame:
    """(model_id, languages): codes that can be reported and that the model accepts, sorted.

    models: model_id, backend; accepted: backend, code. A backend without rows accepts every code.
    """
    limited = accepted.select("backend").distinct().withColumn("limited", F.lit(True))
    m = models.join(limited, "backend", "left")
    some = m.where("limited").join(accepted, "backend").join(codes, "code", "left_semi").select("model_id", "code")
    all_codes = codes.agg(F.collect_set("code").alias("codes"))  # one row, of as many codes as there are languages
    every = m.where("limited is null").crossJoin(F.broadcast(all_codes)).select("model_id", F.explode("codes").alias("code"))
    return some.unionByName(every).groupBy("model_id").agg(F.sort_array(F.collect_set("code")).alias("languages"))


def unsupported_requests(requests: DataFrame, support: DataFrame) -> DataFrame:
    """Requests (model_id, language) without a row in ``support``, each with a message; never a fallback."""
    bad = requests.join(support, ["model_id", "language"], "left_anti")
    return bad.withColumn("error", F.concat(F.lit("model "), "model_id", F.lit(" does not support language "), "language"))
