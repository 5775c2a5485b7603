"""Notes to passages and passages to vectors: one pass of Arrow batches each, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from notefold.chunker.chunk import Settings, chunk
from notefold.embed import Embedder, vector_problem

FEW_ITEMS, ITEMS_A_TASK = 16, 50_000
PASSAGE = "ARRAY<STRUCT<n: INT, trail: ARRAY<STRING>, heads: ARRAY<STRING>, rep: BOOLEAN, line: INT, text: STRING, embed_text: STRING, recovered: BOOLEAN>>"
NOTES = f"path STRING, sha256 STRING, title STRING, aliases ARRAY<STRING>, tags ARRAY<STRING>, indexable BOOLEAN, reason STRING, passages {PASSAGE}"

_PASSAGE = pa.list_(pa.struct([("n", pa.int32()), ("trail", pa.list_(pa.string())), ("heads", pa.list_(pa.string())), ("rep", pa.bool_()), ("line", pa.int32()), ("text", pa.string()), ("embed_text", pa.string()), ("recovered", pa.bool_())]))


def spread(rows: DataFrame, items: int) -> DataFrame:
    """Shared out evenly, about ``items`` of them: cutting and embedding are dear, moving rows isn't."""
    spark = rows.sparkSession
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), items // ITEMS_A_TASK)
    return rows.repartition(max(1, min(-(-items // FEW_ITEMS), most)))


def chunk_notes(notes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Of (path, content BINARY, fip): each note with its passages as a list.

    ``reason`` says why a note is left out: ``index-false`` or ``empty``; null bytes are ``unreadable``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            cols: dict[str, list] = {c: [] for c in ("path", "sha256", "title", "aliases", "tags", "indexable", "reason", "passages")}
            for path, content, fip in zip(*(b.column(c).to_pylist() for c in ("path", "content", "fip"))):
                note = chunk(content or b"", path, bool(fip), settings)
                reason = "unreadable" if content is None else "index-false" if not note.indexable else None if note.passages else "empty"
                values = (path, None if content is None else hashlib.sha256(content).hexdigest(), note.title, note.aliases, note.tags, note.indexable, reason, [vars(p) for p in note.passages])
                for c, v in zip(cols, values):
                    cols[c].append(v)
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string(), _PASSAGE]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], names=list(cols))

    return notes.select("path", "content", "fip").mapInArrow(run, NOTES)


def explode_passages(chunked: DataFrame) -> DataFrame:
    """A row for each passage: (path, sha256, title, n, trail, heads, rep, line, text, embed_text, recovered)."""
    return chunked.where(F.col("reason").isNull()).select("path", "sha256", "title", F.explode("passages").alias("p")).select("path", "sha256", "title", "p.*")


def embed_passages(passages: DataFrame, make: Callable[[], Embedder], text_col: str = "embed_text", batch: int = 128) -> DataFrame:
    """With ``vector``; null where the embedder gave nothing of use twice. ``make`` runs once in each task."""
    dims = make().dimensions
    schema = passages.schema.simpleString()[len("struct<") : -1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passages.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for b in batches:
            texts = b.column(text_col).to_pylist()
            vectors: list[list[float] | None] = []
            for i in range(0, len(texts), batch):
                some = [t or "" for t in texts[i : i + batch]]
                for t, v in zip(some, embedder.embed(some)):
                    if vector_problem(v, dims):
                        v = np.asarray(embedder.embed([t])[0])  # once more, alone
                    vectors.append(None if vector_problem(v, dims) else v.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "vector"])

    del schema
    return passages.mapInArrow(run, f"{fields}, vector ARRAY<FLOAT>")


@udtf(returnType="n INT, trail ARRAY<STRING>, heads ARRAY<STRING>, rep BOOLEAN, line INT, text STRING, embed_text STRING, recovered BOOLEAN")
class ChunkNote:
    """For SQL: ``SELECT * FROM notes, LATERAL chunk_note(content, path, fip)``."""

    def eval(self, content: bytes, path: str, fip: bool):
        for p in chunk(content or b"", path or "", bool(fip)).passages:
            yield p.n, p.trail, p.heads, p.rep, p.line, p.text, p.embed_text, p.recovered


def register_sql(spark: SparkSession) -> None:
    """The chunker as the table function ``chunk_note``, and the text functions as SQL functions."""
    spark.udtf.register("chunk_note", ChunkNote)
    from notefold.functions.text import MAX_TOKEN, WORD

    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION note_tokens(s STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(s), r'{WORD}', 0), t -> length(t) <= {MAX_TOKEN})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))")
