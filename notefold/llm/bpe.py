"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by DuckDB in each partition.

Texts are cut into words by the vocabulary's pattern. For the words that a worker has not met
before, one recursive DuckDB query per batch holds a row for each token position, joins the
neighbours to the merge table, contracts in every word the leftmost pair of least rank, and goes
on until no word has a pair to merge; an ordered aggregation gives the ids. Since natural text
repeats its words, a worker's cache answers nearly all of them afterwards. Nothing is shuffled:
each partition is encoded where it is read, so the work splits as the input does.

The query contracts all places of a word's least pair that don't overlap in one round, from the
left, which gives the same ids as one place at a time. Unbroken runs of more than ``LONGEST`` bytes,
which no language writes, would still make thousands of rounds: for them the same contraction is
done with a heap of pairs, to the same ids.

Defined results: a null or an empty text has the empty list; the names of special tokens are
ordinary text; lone surrogates can't occur in Spark's strings; any length of text is encoded
whole; repeated rows are encoded each; columns of the input other than those named are ignored.

The vocabulary file's path is a parameter; it must be readable at that path on every executor.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_CACHED = 400_000
WORDS_A_QUERY = 20_000
LONGEST = 2_000

_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte to letter as byte-level vocabularies write it: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in visible}
    return out | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


class Encoder:
    """Word to ids, for one worker process."""

    def __init__(self, vocabulary: str):
        import duckdb
        import regex

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = _byte_letters()
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, array] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int]] | None = None
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})  # a query is small: nothing may spill to a worker's own disk
        table = pa.table(
            {
                "l": pa.array([ids[a] for a, _ in merges], pa.int32()),
                "r": pa.array([ids[b] for _, b in merges], pa.int32()),
                "made": pa.array([ids[a + b] for a, b in merges], pa.int32()),
                "rank": pa.array(range(len(merges)), pa.int32()),
            }
        )
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")

    QUERY = """
WITH RECURSIVE step(word, pos, tok, more) AS (
    SELECT word, pos, tok, true FROM start
  UNION ALL
    SELECT word, pos, CASE WHEN hit THEN made ELSE tok END, best IS NOT NULL
    FROM (
      SELECT *, coalesce(lag(hit) OVER w, false) AS eaten
      FROM (
        SELECT *, rank IS NOT NULL AND rank = best AND run % 2 = 0 AS hit
        FROM (
          SELECT *, row_number() OVER (PARTITION BY word, rank = best, block ORDER BY pos) - 1 AS run
          FROM (
            SELECT *, sum(CASE WHEN rank = best THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS block
            FROM (
              SELECT p.word, p.pos, p.tok, m.made, m.rank, min(m.rank) OVER (PARTITION BY p.word) AS best
              FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM step WHERE more) p
              LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
            )
          )
        )
      )
      WINDOW w AS (PARTITION BY word ORDER BY pos)
    )
    WHERE NOT eaten
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT more GROUP BY word
"""

    def contract(self, tokens: list[int]) -> list[int]:
        """The contraction of one long run: pairs wait in a heap by rank and place."""
        if self.pairs is None:
            rows = self.db.sql("SELECT l, r, rank, made FROM merges").fetchall()
            self.pairs = {(a, b): (rank, made) for a, b, rank, made in rows}
        n = len(tokens)
        left, right, alive = [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        waiting = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < n and (m := self.pairs.get((tokens[i], tokens[right[i]]))):
                heapq.heappush(waiting, (m[0], i, tokens[i], tokens[right[i]], m[1]))

        for i in range(n):
            offer(i)
        while waiting:
            _, i, a, b, made = heapq.heappop(waiting)
            j = right[i]
            if not alive[i] or j >= n or tokens[i] != a or tokens[j] != b:
                continue  # one of the two is something else by now
            tokens[i], alive[j], right[i] = made, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [t for t, a in zip(tokens, alive) if a]

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't in the cache."""
        for w in words:
            if len(w) > LONGEST // 4 and len(w.encode("utf-8")) > LONGEST:
                self.cache[w] = array("i", self.contract([self.byte_ids[b] for b in w.encode("utf-8")]))
        words = [w for w in words if w not in self.cache]
        for i in range(0, len(words), WORDS_A_QUERY):
            some = words[i : i + WORDS_A_QUERY]
            raw = [w.encode("utf-8") for w in some]
            lengths = [len(r) for r in raw]
            table = pa.table(
                {
                    "word": pa.array([k for k, n in enumerate(lengths) for _ in range(n)], pa.int32()),
                    "pos": pa.array(chain.from_iterable(map(range, lengths)), pa.int32()),
                    "tok": pa.array([self.byte_ids[b] for b in chain.from_iterable(raw)], pa.int32()),
                }
            )
            self.db.register("start", table)
            found = self.db.sql(self.QUERY).to_arrow_table()
            self.db.unregister("start")
            for k, ids in zip(found["word"].to_pylist(), found["ids"].to_pylist()):
                self.cache[some[k]] = array("i", ids)

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text; afterwards the cache holds all of them."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
        new = set().union(*cut) - self.cache.keys()
        if new:
            self.learn(list(new))
        return cut


def encoder(vocabulary: str) -> Encoder:
    """This process's encoder of a vocabulary; workers keep it from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_texts(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[list[int]]:
    e = encoder(vocabulary)
    return [list(chain.from_iterable(map(e.cache.__getitem__, w))) for w in e.words(texts)]


def _slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded amount of text, so memory doesn't hang on how long texts are."""
    for b in batches:
        rows = max(1, int(b.num_rows * most_bytes / max(1, b.nbytes)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in _slices(batches):
            flat, ends = array("i"), array("i", [0])
            for w in e.words(b.column(1).to_pylist()):
                for ids in map(e.cache.__getitem__, w):
                    flat.extend(ids)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    rows = documents.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, ids ARRAY<INT>")


def count_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the number of token ids of every text, without the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in _slices(batches):
            sizes = [sum(map(len, map(e.cache.__getitem__, w))) for w in e.words(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=[id_col, "tokens"])

    rows = documents.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, tokens LONG")
