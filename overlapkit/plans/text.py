"""Queries of the text operators over ``documents`` with fillers put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from overlapkit.functions import collapse_newlines, normalize_spaces
from overlapkit.operators import text
from overlapkit.plans import read
from overlapkit.plans.fixtures import WORDS

ONE_WORD = {lang: [w for w in words if " " not in w] for lang, words in text.fillers().items()}
PUT_IN = {lang: words[0] for lang, words in ONE_WORD.items()}


def _dirty(spark, sf_dir):
    """(doc_id, lang, text): after word i % 7 = 3 a filler, i % 3 + 1 spaces, three newlines after every 50th word."""
    d = read(spark, sf_dir, "documents")
    filler = F.lit("")
    for lang, w in PUT_IN.items():
        filler = F.when(F.col("lang") == lang, F.lit(" " + w)).otherwise(filler)
    ws = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0b\x0c]+"), lambda w: w != "")
    def put(w, i):
        added = F.when(i % 7 == 3, filler).otherwise("")
        return F.concat(w, added, F.repeat(F.lit(" "), (i % 3 + 1).cast("int")), F.when(i % 50 == 49, "\n\n\n").otherwise(""))
    return d.select("doc_id", "lang", F.array_join(F.transform(ws, put), "").alias("text"))


def e1_remove_fillers(spark, sf_dir):
    return text.remove_fillers(_dirty(spark, sf_dir), "text", "lang", ONE_WORD)


def e2_collapse_newlines(spark, sf_dir):
    return _dirty(spark, sf_dir).select("doc_id", collapse_newlines(F.col("text")).alias("text"))


def e3_normalize_spaces(spark, sf_dir):
    return _dirty(spark, sf_dir).select("doc_id", normalize_spaces(F.col("text")).alias("text"))


def e4_clean_corpus(spark, sf_dir):
    return text.clean_corpus(_dirty(spark, sf_dir), "text", "lang", ONE_WORD)


def e4_clean_corpus_full(spark, sf_dir):
    """With the whole dictionaries, fillers of several words included."""
    return text.clean_corpus(_dirty(spark, sf_dir), "text", "lang").select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def e5_filler_report(spark, sf_dir):
    return text.filler_report(_dirty(spark, sf_dir), "text", "lang", ONE_WORD)


def e6_split_blank(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lit(" \n\t")).otherwise(F.col("text")))
    full, blank = text.split_blank(d, "text")
    return full.groupBy(F.lit("deliver").alias("route")).agg(F.count("*").alias("n")).unionByName(blank.groupBy(F.lit("blank").alias("route")).agg(F.count("*").alias("n")))


def _tags(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "-US").when(k == 1, "-Latn").when(k == 2, "").otherwise("-XX")
    return d.select("doc_id", F.when(F.col("doc_id") % 13 == 0, "xx").otherwise(F.concat("lang", tail)).alias("tag"))


def e7_map_language(spark, sf_dir):
    return text.map_language(_tags(spark, sf_dir), "tag")


def _support(spark, sf_dir):
    """Model = source; even ones take every language of the documents, odd ones those of their own that sort before "fr"."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("model_id"), F.col("lang").alias("code"))


def e8_reachable_languages(spark, sf_dir):
    s = _support(spark, sf_dir)
    even = F.try_to_number(F.substring("model_id", 4, 10), F.lit("999")) % 2 == 0
    models = s.select("model_id", F.when(even, "any").otherwise(F.col("model_id")).alias("backend")).distinct()
    accepted = s.where(~even).where("code < 'fr'").select(F.col("model_id").alias("backend"), "code").distinct()
    out = text.reachable_languages(models, accepted, s.select("code").distinct())
    return out.select("model_id", F.array_join("languages", ",").alias("languages"))


def e9_unsupported_requests(spark, sf_dir):
    tags = text.map_language(_tags(spark, sf_dir), "tag").join(read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model_id")), "doc_id")
    support = _support(spark, sf_dir).where("code != 'es'").select("model_id", F.col("code").alias("language")).distinct()
    return text.unsupported_requests(tags.select("doc_id", "model_id", "language"), support)


QUERIES = {
    f.__name__: f
    for f in (
        e1_remove_fillers, e2_collapse_newlines, e3_normalize_spaces, e4_clean_corpus, e4_clean_corpus_full, e5_filler_report,
        e6_split_blank, e7_map_language, e8_reachable_languages, e9_unsupported_requests,
    )
}

_FILLER = "CASE lang " + " ".join(f"WHEN '{k}' THEN ' {w}'" for k, w in PUT_IN.items()) + " ELSE '' END"
_DIRTY = f"""SELECT doc_id, lang, coalesce(array_to_string([w || CASE WHEN i % 7 = 4 THEN {_FILLER} ELSE '' END || repeat(' ', (i - 1) % 3 + 1) || CASE WHEN i % 50 = 0 THEN repeat(chr(10), 3) ELSE '' END
 FOR w, i IN ws], ''), '') AS text FROM (SELECT doc_id, lang, ws FROM ({WORDS}) JOIN documents USING (doc_id))"""
_LIST = "CASE lang " + " ".join(f"WHEN '{k}' THEN {ws!r}" for k, ws in ONE_WORD.items()) + " ELSE []::VARCHAR[] END"
# Runs of letters and single other characters; a filler goes, and so does one space right after it.
_SPLIT = f"SELECT doc_id, lang, text, {_LIST} AS words, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]') AS ts FROM ({_DIRTY})"
_CLEAN = f"""SELECT doc_id, lang, coalesce(array_to_string([t FOR t, i IN ts IF NOT list_contains(words, lower(t)) AND NOT (t = ' ' AND i > 1 AND list_contains(words, lower(coalesce(ts[i - 1], ''))))], ''), '') AS text
 FROM ({_SPLIT})"""
_PUNCT = ".,!?:;‐-‟‰- 、-〃〈-】〔-〗〝-〯！-｠"
_SPACES = f"regexp_replace(regexp_replace(regexp_replace({{0}}, ' +', ' ', 'g'), ' ([{_PUNCT}])', '\\1', 'g'), ' $', '')"
_LINES = "regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_TAGS = """SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN 'xx' ELSE lang || CASE doc_id % 4 WHEN 0 THEN '-US' WHEN 1 THEN '-Latn' WHEN 2 THEN '' ELSE '-XX' END END AS tag FROM documents"""
_CODES = "(" + ", ".join(f"'{c}'" for c in text.LANGUAGES) + ")"

ORACLE = {
    "e1_remove_fillers": _CLEAN,
    "e2_collapse_newlines": f"SELECT doc_id, {_LINES.format('text')} AS text FROM ({_DIRTY})",
    "e3_normalize_spaces": f"SELECT doc_id, {_SPACES.replace('{0}', 'text')} AS text FROM ({_DIRTY})",
    "e4_clean_corpus": f"SELECT doc_id, lang, regexp_replace(regexp_replace({_SPACES.replace('{0}', _LINES.format('text'))}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') AS text FROM ({_CLEAN})",
    "e5_filler_report": f"""SELECT lang, lower(t) AS filler, count(*) AS removed, count(DISTINCT doc_id) AS documents, sum(length(t) + CASE WHEN nxt = ' ' THEN 1 ELSE 0 END)::BIGINT AS chars
 FROM (SELECT doc_id, lang, words, ts[i] AS t, ts[i + 1] AS nxt FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM ({_SPLIT}))) WHERE list_contains(words, lower(t)) GROUP BY ALL""",
    "e6_split_blank": """SELECT CASE WHEN doc_id % 9 = 0 OR text IS NULL OR regexp_full_match(text, '[\\s\\p{Z}]*') THEN 'blank' ELSE 'deliver' END AS route, count(*) AS n FROM documents GROUP BY 1""",
    "e7_map_language": f"SELECT doc_id, tag, mapped, coalesce(mapped, 'und') AS language FROM (SELECT *, CASE WHEN split_part(tag, '-', 1) IN {_CODES} THEN split_part(tag, '-', 1) END AS mapped FROM ({_TAGS}))",
    "e8_reachable_languages": """WITH m AS (SELECT DISTINCT source, substr(source, 4)::INT % 2 = 0 AS even FROM documents), c AS (SELECT DISTINCT lang FROM documents),
 s AS (SELECT DISTINCT source, lang FROM documents WHERE lang < 'fr'), r AS (SELECT source, lang FROM m, c WHERE even OR source NOT IN (SELECT source FROM s)
 UNION SELECT source, lang FROM s JOIN m USING (source) WHERE NOT even) SELECT source AS model_id, string_agg(lang, ',' ORDER BY lang) AS languages FROM r GROUP BY 1""",
    "e9_unsupported_requests": f"""WITH r AS (SELECT doc_id, source AS model_id, CASE WHEN split_part(tag, '-', 1) IN {_CODES} THEN split_part(tag, '-', 1) ELSE 'und' END AS language FROM ({_TAGS})),
 s AS (SELECT DISTINCT source AS model_id, lang AS language FROM documents WHERE lang <> 'es') SELECT *, 'model ' || model_id || ' does not support language ' || language AS error FROM r ANTI JOIN s USING (model_id, language)""",
}
