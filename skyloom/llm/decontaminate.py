"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: each row holds the token postings of a
block of documents (sorted terms, and for each term the ascending positions),
written once to the shared folder and read by every search.  A search takes
each window's rarest term in the block, and intersects its posting list with
the offset-adjusted lists of the next rarer terms until all have matched.

Building and searching need no shuffle, whatever the terms' frequencies: a
word that every document has only makes one list of each block longer, and is
never a window's first term while a rarer one is there.  The test items are
sent to the tasks in chunks of at most ``CHUNK_BYTES`` of text; several chunks
mean several searches of the stored index.

Words are ``[0-9a-z]`` and everything beyond ASCII, after lower-casing A-Z;
they are cut from the UTF-8 bytes.

Edge cases: a null or empty text has no words and no hits; an item without
words has no windows and occurs nowhere; repeated item ids count once; an item
with a null id is searched like others, its hits count and contaminate, only
``items`` leaves it out (``ORACLE_SQL`` has no such items);
repeated documents are reported each.  Empty tables give empty results, no
items give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_id, dropped, stored, table, with_own_ids

WINDOW = 10
#: Text of one block of the index.
BLOCK_BYTES = 6_000_000
#: Text of the items that are sent to all tasks at once.
CHUNK_BYTES = 8_000_000

TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "block string, ids array<bigint>, starts binary, counts binary, terms binary, offsets binary, positions binary"


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    """Ids and texts of as many documents as fill a block."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).cast(pa.large_binary())):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            size += len(t or b"")
            if size >= BLOCK_BYTES or len(ids) >= 50_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def index_block(ids: list, texts: list[bytes | None]) -> dict:
    """Postings of a block.  Documents are laid out one after another with a gap of
    one position, so no phrase can reach from one into the next."""
    counts = np.empty(len(ids), np.int32)
    words: list[bytes] = []
    for k, t in enumerate(texts):
        own = tokens(t)
        counts[k] = len(own)
        words += own
    starts = np.concatenate([[0], np.cumsum(counts.astype(np.int64) + 1)[:-1]]).astype(np.int32) if len(ids) else np.empty(0, np.int32)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    terms = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
    places = np.arange(len(words), dtype=np.int32) + np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    order = np.argsort(terms, kind="stable")
    sizes = np.bincount(terms, minlength=len(vocabulary)) if len(words) else np.zeros(0, np.int64)
    return {
        "ids": ids, "starts": starts.tobytes(), "counts": counts.tobytes(), "terms": b" ".join(vocabulary),
        "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes(), "positions": places[order].tobytes(),
    }


SCHEMA = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("starts", "counts", "terms", "offsets", "positions")]])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents: see ``INDEX``.  ``stored(build_index(...))`` writes it; a block's number is its task's and its place in it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (ids, texts) in enumerate(blocks(batches), TaskContext.get().partitionId() << 33):
            yield pa.RecordBatch.from_pylist([{"block": str(k)} | index_block(ids, texts)], SCHEMA)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(build, INDEX)


class Postings:
    """A block of the index, as read back."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.starts, self.counts, self.offsets, self.positions = (np.frombuffer(row[c], np.int32) for c in ("starts", "counts", "offsets", "positions"))
        self.terms = {w: i for i, w in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.size = int(self.starts[-1] + self.counts[-1] + 1) if len(self.ids) else 0
        # (term, position) as one sorted key, for intersections
        self.keys = np.repeat(np.arange(len(self.offsets) - 1, dtype=np.int64), np.diff(self.offsets)) * (self.size + 1) + self.positions

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting lists of ``terms``, one after another: positions, and the index of the term."""
        n = self.offsets[terms + 1] - self.offsets[terms]
        which = np.repeat(np.arange(len(terms)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offsets[terms], n)
        return self.positions[at].astype(np.int64), which

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each place is in its term's list."""
        want = terms.astype(np.int64) * (self.size + 1) + places
        at = np.searchsorted(self.keys, want)
        return (places >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)

    def present(self, matrix: np.ndarray, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Windows (rows of global term ids) whose terms all occur here: their indexes, and local term ids."""
        here = np.fromiter((self.terms.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
        local = here[matrix]
        some = np.flatnonzero((local >= 0).all(axis=1))
        return some, local[some]

    def phrases(self, matrix: np.ndarray, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences of windows of one length: window indexes and start positions."""
        some, local = self.present(matrix, vocabulary)
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rarity = np.argsort(np.diff(self.offsets)[local], axis=1, kind="stable")
        rows = np.arange(len(some))
        places, which = self.lists(local[rows, rarity[:, 0]])
        starts = places - rarity[which, 0]
        for k in range(1, matrix.shape[1]):
            off = rarity[which, k]
            ok = self.has(local[which, off], starts + off)
            starts, which = starts[ok], which[ok]
        return some[which], starts

    def near(self, matrix: np.ndarray, vocabulary: list[bytes], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Proximity matches: places of a window's rarest term with every other term of it at most ``slop`` words away, in the same document."""
        some, local = self.present(matrix, vocabulary)
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rarity = np.argsort(np.diff(self.offsets)[local], axis=1, kind="stable")
        places, which = self.lists(local[np.arange(len(some)), rarity[:, 0]])
        for k in range(1, matrix.shape[1]):
            doc = np.searchsorted(self.starts, places, "right") - 1
            low = np.maximum(places - slop, self.starts[doc])
            high = np.minimum(places + slop, self.starts[doc] + self.counts[doc] - 1)
            term = local[which, rarity[which, k]] * (self.size + 1)
            ok = np.searchsorted(self.keys, term + low) < np.searchsorted(self.keys, term + high, "right")
            places, which = places[ok], which[ok]
        return some[which], places


class Windows:
    """The items' windows, grouped by length, as global term ids."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in tokens(text)]
            n = min(width, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                by.setdefault(n, {}).setdefault(tuple(ids[at : at + n]), []).append(k)
        self.vocabulary = list(vocabulary)
        self.groups = [(np.array(list(w), np.int64), [sorted(set(x)) for x in w.values()]) for w in by.values()]


def search(index: DataFrame, items: list[tuple[str | None, bytes | None]], width: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Every document of the index: block, place in it, doc_id, n_words, ``spans`` of hit
    words [start, end) without overlaps, and the ids of the items that occur, without null.

    With ``slop``, proximity matches: a span is the place of a window's rarest term.
    """
    windows = Windows(items, width)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = Postings(row)
                edge = np.zeros(p.size + 2, np.int32)
                got: dict[int, set[str]] = {}
                for matrix, owners in windows.groups:
                    which, at = p.phrases(matrix, windows.vocabulary) if slop is None else p.near(matrix, windows.vocabulary, slop)
                    if not len(which):
                        continue
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + (matrix.shape[1] if slop is None else 1), -1)
                    doc = np.searchsorted(p.starts, at, "right") - 1
                    for d, w in set(zip(doc.tolist(), which.tolist())):
                        got.setdefault(d, set()).update(windows.items[k] for k in owners[w] if windows.items[k] is not None)
                spans: dict[int, list[list[int]]] = {}
                if got:
                    step = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
                    for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
                        d = int(np.searchsorted(p.starts, s, "right")) - 1
                        spans.setdefault(d, []).append([int(s - p.starts[d]), int(e - p.starts[d])])
                n = len(p.ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(p.ids, pa.int64()), pa.array(p.counts, pa.int64()),
                    pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.list_(pa.int32()))), pa.array([sorted(got.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                ], ["block", "place", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(find, "block string, place int, doc_id bigint, n_words bigint, spans array<array<int>>, items array<string>")


def item_chunks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in chunks of about ``chunk_bytes``, so that what tasks get is bounded."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + size // chunk_bytes
    for k in range(n):
        yield [(r.i, bytes(r.t) if r.t is not None else None) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, spans and items of each row of ``docs``; builds and stores the index, which goes after the searches."""
    index = stored(build_index(docs), "postings")
    parts = [stored(search(index, chunk, width, slop), "found") for chunk in item_chunks(items, chunk_bytes=chunk_bytes)]
    dropped(index)
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", "spans", "items")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p.where(F.size("spans") > 0))
    joined = every.groupBy("block", "place").agg(
        F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = """aggregate(spans, cast(array() as array<array<int>>), (a, s) -> if(size(a) > 0 and a[size(a) - 1][1] >= s[0],
        concat(slice(a, 1, size(a) - 1), array(array(a[size(a) - 1][0], greatest(a[size(a) - 1][1], s[1])))), concat(a, array(s))))"""
    return joined.select("doc_id", "n_words", F.expr(merged).alias("spans"), "items")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those in which a window of an item occurs, and others with their doc_id; rows with a null doc_id each by themselves."""

    def clean(rows: DataFrame) -> DataFrame:
        found = contamination(rows, items).where("size(spans) > 0").select("doc_id").distinct()
        return by_id(rows, found, "left_anti")

    return with_own_ids(docs, clean)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("cast(aggregate(spans, 0, (a, s) -> a + s[1] - s[0]) as bigint)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (
    SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(0, len(w) - least({WINDOW}, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0)),
occ AS (SELECT r, i, t.n, s FROM (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (
    SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) AS l WHERE len(w) >= n)) AS t
    WHERE s IN (SELECT s FROM win WHERE win.n = t.n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ JOIN win USING (n, s)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
