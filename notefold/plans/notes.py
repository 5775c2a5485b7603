"""Queries of the chunker over whole texts, what its passages must be like, and worked examples.

The rules as a whole are no SQL. What holds for every note is told from the passages alone, by
expressions that the chunker doesn't use; single rules are held to examples with known answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.embed import HashedWords
from notefold.functions.text import stand_in_size
from notefold.functions.vectors import vector_ok
from notefold.operators.chunking import PASSAGE, chunk_notes, embed_passages, explode_passages
from notefold.operators.plan import folder_flags
from notefold.plans.examples import EXAMPLES, answer


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a note in a folder of its own: several documents may have one key."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("note_key", F.lit("Unnamed.md")))
    return folder_flags(docs.select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")))


def chunk_passages(spark: SparkSession, d: str) -> DataFrame:
    return explode_passages(chunk_notes(_notes(spark, d))).select("path", "n", "line", "rep", "recovered", F.array_join("trail", " > ").alias("section"), F.sha2("embed_text", 256).alias("sha256"))


def chunk_notes_left_out(spark: SparkSession, d: str) -> DataFrame:
    return chunk_notes(_notes(spark, d)).where(F.col("reason").isNotNull()).select("path", "reason")


def note_properties(spark: SparkSession, d: str) -> DataFrame:
    return chunk_notes(_notes(spark, d)).select("path", "title", F.array_join("aliases", ", ").alias("aliases"), F.array_join("tags", ", ").alias("tags"))


def embedded_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage's vector by the embedder that needs no model."""
    return embed_passages(explode_passages(chunk_notes(_notes(spark, d))).select("path", "n", "embed_text"), HashedWords).select("path", "n", "vector")


def chunk_passages_hold(spark: SparkSession, d: str) -> DataFrame:
    """Of every note: whether its passages fit the window, are numbered without gaps, begin on rising lines of it and belong to it."""
    notes = _notes(spark, d)
    rows = chunk_notes(notes).select("path", F.coalesce("passages", F.array().cast(PASSAGE)).alias("p")).join(notes.select("path", F.decode("content", "utf-8").alias("text")), "path")
    lines = F.size(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    of_note = F.array_union(words(F.col("text")), words(F.col("path")))
    rising = F.transform("p", lambda x: x["line"])
    return rows.select(
        "path",
        F.forall("p", lambda x: (stand_in_size(x["embed_text"]) <= 110) & (x["text"] != "")).alias("all_fit"),
        (F.transform("p", lambda x: x["n"]) == F.transform("p", lambda _, i: i)).alias("numbered"),
        ((rising == F.array_sort(rising)) & F.forall("p", lambda x: x["line"].between(1, lines))).alias("in_order"),
        # A word that was cut inside or an address cut to its host may give words that the note doesn't have as such.
        F.forall("p", lambda x: F.size(F.array_except(words(x["text"]), of_note)) * 4 <= F.size(words(x["text"])) + 4).alias("of_the_note"),
    )


def embedded_passages_hold(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether each passage with a word has a usable vector of length 1, and equal texts have equal vectors."""
    rows = embed_passages(explode_passages(chunk_notes(_notes(spark, d))).select("path", "n", "embed_text"), HashedWords)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    one = F.coalesce(vector_ok("vector", 64) & (F.abs(length - 1) < 1e-5), F.regexp_count("embed_text", F.lit(r"[\p{L}\p{N}\p{M}]")) == 0)
    per_text = rows.groupBy("embed_text").agg(F.min(F.col("vector").cast("string")).alias("a"), F.max(F.col("vector").cast("string")).alias("b"), F.min(one).alias("one"))
    return per_text.agg(F.coalesce(F.min("one"), F.lit(True)).alias("all_usable"), F.coalesce(F.min(F.col("a") == F.col("b")), F.lit(True)).alias("same_text_same_vector"))


def chunk_examples(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([(i, kind, text) for i, (kind, text, _) in enumerate(EXAMPLES)], "id INT, kind STRING, given STRING")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [answer(k, g) for k, g in zip(b.column("kind").to_pylist(), b.column("given").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("kind"), pa.array(found, pa.string())], names=["id", "kind", "found"])

    return given.mapInArrow(run, "id INT, kind STRING, found STRING")


QUERIES = {f.__name__: f for f in (chunk_passages, chunk_passages_hold, chunk_notes_left_out, note_properties, embedded_passages, embedded_passages_hold, chunk_examples)}


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_NOTE = "concat(doc_id, '/', coalesce(note_key, 'Unnamed.md'))"
# The properties as they are written in these notes: an inline list of aliases and an indented list of tags.
_PROPERTIES = rf"""
WITH n AS (SELECT {_NOTE} AS path, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
p AS (SELECT path, regexp_extract(t, '^\x{{FEFF}}?---[ \t]*\n((?s:.*?))\n---[ \t]*(\n|$)', 1) AS block FROM n)
SELECT path, regexp_replace(string_split(path, '/')[-1], '(?i)\.md$', '') AS title,
  array_to_string(list_filter(list_transform(string_split(regexp_extract(block, '(?:^|\n)alias(?:es)?: *\[([^\]]*)\]', 1), ','), lambda y: trim(y)), lambda y: y <> ''), ', ') AS aliases,
  array_to_string(list_filter(list_transform(string_split(regexp_extract(block, '(?:^|\n)tags?:((?:\n +- [^\n]+)+)', 1), chr(10)), lambda y: trim(regexp_replace(y, '^ *- ', ''))), lambda y: y <> ''), ', ') AS tags
FROM p"""
# Of these notes those with fewer than three words beside properties and headings have no section with three.
_LEFT_OUT = rf"SELECT {_NOTE} AS path, 'empty' AS reason FROM documents WHERE len(regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '^---\r?\n(?s:.*?)\n---\r?(\n|$)', ''), '(^|\n)#+ [^\n]*', '', 'g'), '\S+')) < 3"
ORACLES = {
    "chunk_passages_hold": f"SELECT {_NOTE} AS path, true AS all_fit, true AS numbered, true AS in_order, true AS of_the_note FROM documents",
    "chunk_notes_left_out": _LEFT_OUT,
    "note_properties": _PROPERTIES,
    "embedded_passages_hold": "SELECT true AS all_usable, true AS same_text_same_vector",
    "chunk_examples": "SELECT id::INT AS id, kind, found FROM (VALUES " + ", ".join(f"({i}, '{k}', {_quoted(w)})" for i, (k, _, w) in enumerate(EXAMPLES)) + ") AS t(id, kind, found)",
}
