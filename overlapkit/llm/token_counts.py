"""Token counts of a document's fields or sections, from one encoding of the whole document.

The document is encoded once, as one text. A byte-level token is a run of bytes, so the tokens' spans
follow from their lengths; sections are spans of the same bytes; the two lists are joined by
interval. A token inside one section counts there. One that crosses a boundary goes by ``rule``:

* "largest": to the section with most of its bytes, the earlier of equals (the default);
* "first": to the section of its first byte;
* "split": to each section in proportion to its bytes (counts are then fractions).

Under every rule a document's sections add up to its tokens.

The tokenizer's own matcher recurses over a run of white space and ends the worker at some hundred
thousand characters. A long run is therefore cut out before it: where the pattern ends in ``RUNS``, such a
run is one match up to its last character (or to the text's end), and matching goes on with that
character; both sides and the run are encoded apart and give the tokens of the whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

RULES = ("largest", "first", "split")
RUNS, LONG = r"|\s+(?!\S)|\s+", 10_000  # how patterns match white space; runs of so many characters are cut out
# The characters with the property White_Space.
SPACES = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


NAMES = ("section_no", "field", "first", "last", "n_tokens", "doc_tokens")


@cache
def encoding(path: str, pattern: str):
    """(encoding, byte length of each token) of a rank file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(enc, text: str, pattern: str) -> list[int]:
    """Ids of a text with white space of any length."""
    if len(text) < LONG or not pattern.endswith(RUNS):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def attribute(lengths: np.ndarray, bounds: np.ndarray, rule: str = "largest") -> np.ndarray:
    """Tokens of each section; tokens and sections both tile the same bytes.

    lengths: bytes of each token; bounds: section k is bounds[k] to bounds[k + 1].
    """
    sections = len(bounds) - 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # of sections that begin at the same byte, all but the last are empty
    first = np.searchsorted(bounds[:-1], starts, side="right") - 1
    last = np.searchsorted(bounds[:-1], ends - 1, side="right") - 1
    out = np.bincount(first[first == last], minlength=sections).astype(np.float64)
    for k in np.flatnonzero(first != last).tolist():
        own = np.arange(first[k], last[k] + 1)
        part = np.minimum(bounds[own + 1], ends[k]) - np.maximum(bounds[own], starts[k])
        if rule == "split":
            out[own] += part / lengths[k]
        else:
            out[own[0] if rule == "first" else own[np.argmax(part)]] += 1
    return out


def section_bounds(text: bytes) -> np.ndarray:
    """Lines, each with the new line that ends it; an empty text is one empty section."""
    at = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    bounds = np.r_[0, at]
    return bounds if len(text) and bounds[-1] == len(text) else np.r_[bounds, len(text)]


def count_tokens(
    docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), sections: str = "lines", separator: str = "\n\n", rule: str = "largest"
) -> DataFrame:
    """(id, section_no, field, first, last, n_tokens, doc_tokens): one row per section of each document.

    The document is its ``fields`` joined by ``separator`` (which belongs to the field before it).
    sections "fields" makes a section of each field, "lines" of each line of the whole; ``field`` is
    the number of the field in which a section begins. first and last are character places.

    Cases: null fields are empty; a document without text has its sections with 0 tokens; repeated
    rows are counted alike, each with rows of its own; an empty table gives no rows. A text of any length,
    of white space too, is encoded whole. An ``id_col`` with the name of a result's column is an error.
    """
    if id_col in NAMES:
        raise ValueError(f"{id_col} is a column of the result: rename it")
    if rule not in RULES or sections not in ("fields", "lines"):
        raise ValueError("rule is one of " + ", ".join(RULES) + "; sections is fields or lines")
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(f"f{k}") for k, c in enumerate(fields)]).alias("f"))
    whole = rows.select("id", F.concat_ws(separator, *[F.col(f"f.f{k}") for k in range(len(fields))]).alias("text"),
                        F.array(*[F.octet_length(F.col(f"f.f{k}")) for k in range(len(fields))]).alias("sizes"))
    gap = len(separator.encode())
    number = "double" if rule == "split" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, length_of = encoding(ranks, pattern)
        for batch in S.slices(batches, "text"):
            texts, sizes = S.strings(batch.column("text")), batch.column("sizes").to_pylist()
            take, cols = [], [[] for _ in range(6)]
            for k, text in enumerate(texts):
                raw = text.encode()
                lengths = length_of[np.array(encode(enc, text, pattern), dtype=np.int64)]
                field_ends = np.cumsum(np.array(sizes[k], dtype=np.int64) + gap)
                field_ends[-1] = len(raw)
                starts = np.r_[0, field_ends[:-1]]
                bounds = np.r_[0, field_ends] if sections == "fields" else section_bounds(raw)
                n = attribute(lengths, bounds, rule)
                chars = bounds
                if len(text) != len(raw):  # places in bytes to places in characters
                    lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
                    chars = np.r_[0, np.cumsum(lead)][bounds]
                take.append(len(n))
                for col, v in zip(cols, (np.arange(len(n)), np.searchsorted(starts, bounds[:-1], side="right") - 1, chars[:-1], chars[1:], n, np.full(len(n), len(lengths))), strict=True):
                    col.append(v)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(texts)), take)))
            made = [np.concatenate(c) for c in cols]
            made = [x.astype(np.float64 if k == 4 and rule == "split" else np.int64) for k, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, made)], names=["id", "section_no", "field", "first", "last", "n_tokens", "doc_tokens"])

    schema = S.schema_of(whole, ["id"], section_no="long", field="long", first="long", last="long", n_tokens=number, doc_tokens="long")
    out = whole.mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
