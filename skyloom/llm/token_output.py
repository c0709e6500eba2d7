"""Token ids in a compact binary format: canonical length-limited Huffman codes.

Format: a folder with three Parquet tables, so that any store Spark can write
serves.

* ``codebook``: one row for each id that occurs: ``id``, ``bits`` (its code's
  length, at most ``LIMIT``) and ``n`` (its global count).  The codes are
  canonical: by length, then id.
* ``blocks``: independent blocks, ascending by (``part``, ``first``), with whole
  documents in ascending order of their ids.  ``payload`` has the codes, most
  significant bit first; each document begins at a byte.  ``checkpoints`` has
  the bit offset of every ``STRIDE``-th id of each document (little-endian
  unsigned 64-bit); ``ids`` and ``counts`` the documents and how many ids each has.
* ``starts``: for each block, the ids in all blocks before.

Decoding looks up the longest code's bits at a time in one table; all
stretches between a block's checkpoints are decoded side by side.

The texts are encoded once; their ids go to ranges of document ids and are
stored in order, as 16-bit numbers where the vocabulary allows.  What follows
reads those: the counts, summed by id before they reach the driver (at most as
many rows as the vocabulary has), and then the codes, without a shuffle.

Edge cases: a null text is an empty one and has the end id alone; a null
document id sorts first; repeated documents are written each; an empty table
gives an empty codebook and no rows.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import deleted, partitions, scratch, table

END = 2
LIMIT = 18
STRIDE = 512
BLOCK_IDS = 1_000_000
#: Words whose ids a worker process remembers; the frequent ones come early.
KNOWN_WORDS = 600_000
#: Text that is encoded at once, and that a range of document ids has on average.
ENCODE_BYTES, RANGE_BYTES = 8_000_000, 256_000_000
#: A private-use character: by its bytes, only itself has its ids.
BETWEEN = "\ue000"

#: One run of letters that lower-casing and NFC treat one by one, and ASCII marks after it (but the apostrophe), which are a word of their own.
SIMPLE = "^(?P<w>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(?P<s>[!-&(-/:-@\\[-`{-~]*)$"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of stretches, one after another."""
    ends = np.cumsum(sizes)
    kind = np.int32 if len(ends) and max(ends[-1], starts.max()) < 2**31 - 1 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return at


class Memory:
    """Words and their ids, as arrays; words beyond ``KNOWN_WORDS`` are learnt again each time."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.words, self.ids, self.sizes = pa.array([""], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words that were needed, and where those of each of ``words`` begin and how many they are."""
        at = pc.index_in(words, value_set=self.words)
        ids, sizes = self.ids, self.sizes
        places = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            missing = words.filter(at.is_null())
            more, own = self.learn(missing.to_pylist())
            places[places < 0] = np.arange(len(sizes), len(sizes) + len(own))
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, own])
            if len(self.sizes) < KNOWN_WORDS:
                self.words, self.ids, self.sizes = pa.concat_arrays([self.words, missing]), ids, sizes
        return ids, (np.cumsum(sizes) - sizes)[places], sizes[places]


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    The tokenizer drops white space and never merges across it, so the parts
    between spaces are encoded on their own, and each different part once.
    Parts of letters with stops after them are many but share their letters;
    those that aren't known yet are encoded many at a time, and their ids told
    apart by the mark at each word's end.  Such letters are one word each and
    in lower case, so the library encodes them with the same model but without
    the normaliser and the word pattern.  All other parts are encoded many at a
    time as well, with a character between them that none of them has.

    This holds for tokenizers of ``NORMALISER`` and ``WORDS`` with ends of words;
    with any other one the library encodes the texts as they are.
    """

    NORMALISER = ["NFC", "Replace", "Lowercase"]
    WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        # a task has one core; each thread of the library would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.by_words = self.splits_words(json.loads(Path(path).read_text()))
        if not self.by_words:
            return
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.between = self.plain([BETWEEN])[0]
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.letters, self.stops, self.others = Memory(self.learn_letters), Memory(self.learn_plain), Memory(self.learn_apart)

    def splits_words(self, form: dict) -> bool:
        """Whether a tokenizer's file says what ``encode`` relies on."""
        normaliser, words, model = form.get("normalizer") or {}, (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], form["model"]
        return (
            [n["type"] for n in normaliser.get("normalizers", [])] == self.NORMALISER and [w.get("type") for w in words] == ["Split", "ByteLevel"]
            and words[0]["pattern"] == {"Regex": self.WORDS} and words[0]["behavior"] == "Removed" and words[0]["invert"] and not words[1]["add_prefix_space"] and not words[1]["use_regex"]
            and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not any(form.get(k) for k in ("truncation", "padding", "post_processor"))
            and all(not (t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in form["added_tokens"]))

    def plain(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def learn_plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = self.plain(parts)
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)

    def learn_apart(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that have no white space inside or at their ends that ASCII has."""
        out, sizes = [], []
        groups = [parts[i : i + 100] for i in range(0, len(parts), 100)]
        n = len(self.between)
        for group, ids in zip(groups, self.plain([f" {BETWEEN} ".join(g) for g in groups])):
            hit = np.ones(max(0, len(ids) - n + 1), bool)
            for k, one in enumerate(self.between):
                hit &= ids[k : k + len(hit)] == one
            cuts = np.flatnonzero(hit)
            if len(cuts) != len(group) - 1:  # a part has the character
                ids, own = self.learn_plain(group)
            else:
                own = np.diff(np.concatenate([[-n], cuts, [len(ids)]])) - n
                ids = np.delete(ids, (cuts[:, None] + np.arange(n)).ravel())
            out.append(ids)
            sizes.append(own)
        return np.concatenate(out), np.concatenate(sizes)

    def learn_letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [], []
        groups = [parts[i : i + 500] for i in range(0, len(parts), 500)]
        for group, ids in zip(groups, self.plain([" ".join(g) for g in groups], self.words)):
            own = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(own) != len(group):
                ids, own = self.learn_plain(group)
            out.append(ids)
            sizes.append(own)
        return np.concatenate(out), np.concatenate(sizes)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_words:
            return self.plain(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        simple = pc.extract_regex(words.dictionary, SIMPLE)
        ok = simple.is_valid()
        simple = simple.filter(ok)
        letters, stops = pc.utf8_lower(simple.field("w")).dictionary_encode(), simple.field("s").dictionary_encode()
        # each part has two stretches of ids: those of its letters or of all of it, and of the stops
        starts, sizes = np.zeros((len(ok), 2), np.int64), np.zeros((len(ok), 2), np.int64)
        ok = ok.to_numpy(zero_copy_only=False)
        found, base = [], 0
        for memory, own, rows, col, codes in (
            (self.letters, letters.dictionary, ok, 0, letters.indices), (self.stops, stops.dictionary, ok, 1, stops.indices),
            (self.others, words.dictionary.filter(pa.array(~ok)), ~ok, 0, None),
        ):
            ids, at, n = memory.look_up(own)
            if codes is not None:
                at, n = at[codes.to_numpy()], n[codes.to_numpy()]
            starts[rows, col], sizes[rows, col] = at + base, n
            found.append(ids)
            base += len(ids)
        parts = np.concatenate(found)[expanded(starts.ravel(), sizes.ravel())]
        sizes = sizes.sum(1)
        codes = words.indices.to_numpy()
        n = sizes[codes]
        out = parts[expanded((np.cumsum(sizes) - sizes)[codes], n)]
        cuts = np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [out[x:y] for x, y in zip(cuts, cuts[1:])]


ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The process's encoder: tasks that follow each other in a worker share what it remembers."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def by_bytes(batch: pa.RecordBatch, column: str, most: int = ENCODE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of ``column`` each, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def counted(ids: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs in the stored ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.column("ids").slice(at, 500).to_pylist()
                got = np.bincount(np.frombuffer(b"".join(part), kind))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) < 2:
        return {s: 1 for s in symbols}
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} ids need codes of more than {limit} bits")
    # only how many leaves each level takes is needed: levels as lists of weights, packages as None
    leaves = [counts[s] for s in symbols]
    levels, packages = [], []
    for _ in range(limit):
        merged = list(heapq.merge(((w, 0) for w in leaves), ((w, 1) for w in packages)))
        levels.append(merged)
        packages = [merged[i][0] + merged[i + 1][0] for i in range(0, len(merged) - 1, 2)]
    bits = np.zeros(len(symbols) + 1, np.int64)
    take = 2 * len(symbols) - 2
    for merged in reversed(levels):
        inner = sum(kind for _, kind in merged[:take])
        bits[take - inner] -= 1
        bits[0] += 1
        take = 2 * inner
    lengths = np.cumsum(bits)[:-1]
    return {s: int(n) for s, n in zip(symbols, lengths)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and codes, by length and id."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits = np.array([lengths[s] for s in order], np.int64)
    codes = np.zeros(len(order), np.int64)
    code = last = 0
    for k, n in enumerate(bits.tolist()):
        code <<= n - last
        codes[k], last = code, n
        code += 1
    return np.array(order, np.int64), bits, codes


class Codec:
    """Coder and decoder for a canonical code."""

    def __init__(self, lengths: dict[int, int]):
        ids, bits, codes = canonical(lengths)
        self.width = int(bits.max()) if len(bits) else 1
        top = int(ids.max()) + 1 if len(ids) else 0
        self.bits, self.codes = np.zeros(top, np.uint8), np.zeros(top, np.uint32)
        self.bits[ids], self.codes[ids] = bits, codes
        self.table_ids, self.table_bits = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.uint8)
        runs = 1 << (self.width - bits)
        if len(ids):
            self.table_ids[: runs.sum()] = np.repeat(ids, runs)
            self.table_bits[: runs.sum()] = np.repeat(bits, runs)

    def encode(self, ids: np.ndarray, counts: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """Payload of documents of ``counts`` ids each, and the bit offsets of each one's every ``stride``-th id."""
        n = self.bits[ids].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(counts)
        whole = (at[ends] - at[ends - counts] + 7) >> 3
        begins = np.cumsum(whole) - whole
        at = at[:-1] + np.repeat(begins * 8 - at[ends - counts], counts)
        size = int(whole.sum()) + 4
        # a code lies in at most four bytes, and codes share no bit: bytes may be summed
        shifted = self.codes[ids].astype(np.int64) << (32 - n - (at & 7))
        out = np.zeros(size, np.float64)
        for b in range(4):
            out += np.bincount((at >> 3) + b, (shifted >> (24 - 8 * b)) & 255, minlength=size)[:size]
        lanes = -(-counts // stride)
        lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        return out[:-4].astype(np.uint8).tobytes(), at[np.repeat(ends - counts, lanes) + lane * stride]

    def decode(self, payload: bytes, checkpoints: np.ndarray, counts: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        data = np.frombuffer(payload + bytes(8), np.uint8)
        quads = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
        lanes = -(-counts // stride)
        length = np.full(int(lanes.sum()), stride, np.int64)
        length[np.cumsum(lanes) - 1] = counts - (lanes - 1) * stride
        first = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")  # those that end first are last
        at, first = checkpoints.astype(np.int64)[order], first[order]
        active = np.searchsorted(-length[order], -np.arange(1, stride + 1), "right")
        out, keep = np.zeros(int(counts.sum()), np.uint32), (1 << self.width) - 1
        for k in range(stride):
            n = int(active[k])
            if not n:
                break
            at = at[:n]
            peek = (quads[at >> 3] >> (32 - self.width - (at & 7)).astype(np.uint32)) & keep
            out[first[:n] + k] = self.table_ids[peek]
            at = at + self.table_bits[peek]
        return out


IDS = "part int, doc_id bigint, n bigint, ids binary"
BLOCKS = "part int, first bigint, ids array<bigint>, counts binary, n bigint, payload binary, checkpoints binary"
SCHEMA = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("n", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.binary())])


def store_ids(docs: DataFrame, folder: str, path: str, kind: str, end: int) -> DataFrame:
    """part, first, doc_id, n and ids of each document, in the order of ``first`` within a part.

    A part is a range of ids, as many as the text's size asks for.  An id that fills several ranges has its rows dealt to them by their text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // RANGE_BYTES))
    cuts = np.array(docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or [], np.int64)
    docs = docs.select("doc_id", "text", key.alias("key"), F.xxhash64("text").alias("salt"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = encoder_of(path), np.array([end], kind).tobytes()
        gc.disable()  # many small objects, no cycles
        try:
            for batch in batches:
                for some in by_bytes(batch, "text"):
                    own = [x.astype(kind).tobytes() + last for x in encoder.encode(some.column("text"))]
                    key = some.column("key").to_numpy()
                    part = np.searchsorted(cuts, key, "left")
                    part += some.column("salt").to_numpy() % np.maximum(1, np.searchsorted(cuts, key, "right") - part)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), some.column("doc_id"), pa.array([len(x) // len(last) for x in own], pa.int64()), pa.array(own, pa.binary())], ["part", "doc_id", "n", "ids"])
        finally:
            gc.enable()

    rows = docs.mapInArrow(encode, IDS)
    rows = rows.repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "n", "ids").withColumn("first", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(folder)
    del rows
    # the shuffle's files are as large as the ids; Spark deletes them once the driver's objects are gone
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(folder)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the format to ``folder``."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    kind = "<u2" if max(Encoder(path).size, end + 1) <= 1 << 16 else "<u4"
    ids = store_ids(docs, f"{folder}/ids", path, kind, end)
    counts = counted(ids, kind)
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(n), int(counts[i])) for i, n in sorted(lengths.items())], "id bigint, bits int, n bigint").coalesce(1).write.parquet(f"{folder}/codebook")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows, size = Codec(lengths), [], 0

        def block():
            n = np.array([r["n"] for r in rows], np.int64)
            own = np.frombuffer(b"".join(r["ids"] for r in rows), kind)
            payload, marks = codec.encode(own, n)
            return pa.RecordBatch.from_pylist([{
                "part": rows[0]["part"], "first": rows[0]["first"], "ids": [r["doc_id"] for r in rows], "counts": n.astype("<u4").tobytes(), "n": size,
                "payload": payload, "checkpoints": marks.astype("<u8").tobytes()}], SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for r in batch.slice(at, 500).to_pylist():
                    if rows and (size >= BLOCK_IDS or r["part"] != rows[0]["part"] or r["first"] != rows[-1]["first"] + 1):
                        yield block()
                        rows, size = [], 0
                    rows.append(r)
                    size += r["n"]
        if rows:
            yield block()

    ids.select("part", "first", "doc_id", "n", "ids").mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")
    # ids before each block: sums over the parts first, which are as many as partitions
    sizes = spark.read.parquet(f"{folder}/blocks").select("part", "first", "n")
    per = sizes.groupBy("part").agg(F.sum("n").alias("all")).withColumn("base", F.sum("all").over(W.orderBy("part")) - F.col("all"))
    inside = sizes.withColumn("upto", F.sum("n").over(W.partitionBy("part").orderBy("first")) - F.col("n"))
    inside.join(per, "part").select("part", "first", (F.col("base") + F.col("upto")).alias("start")).write.parquet(f"{folder}/starts")
    deleted(spark, f"{folder}/ids")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """part, first, doc_id, ``at`` (ids before it in its block), n_tokens and tokens (little-endian unsigned 32-bit) of each document."""
    lengths = {r.id: r.bits for r in spark.read.parquet(f"{folder}/codebook").collect()}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.frombuffer(r["counts"], "<u4").astype(np.int64)
                ids = codec.decode(r["payload"], np.frombuffer(r["checkpoints"], "<u8"), counts).astype("<u4")
                ends = np.cumsum(counts)
                for k in range(0, len(counts), 2000):
                    e, c = ends[k : k + 2000], counts[k : k + 2000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["part"]] * len(c), pa.int32()), pa.array([r["first"]] * len(c), pa.int64()), pa.array(r["ids"][k : k + 2000], pa.int64()),
                        pa.array(e - c), pa.array(c), pa.array([ids[y - z : y].tobytes() for y, z in zip(e.tolist(), c.tolist())], pa.binary())],
                        ["part", "first", "doc_id", "at", "n_tokens", "tokens"])

    return spark.read.parquet(f"{folder}/blocks").select("part", "first", "ids", "counts", "payload", "checkpoints").mapInArrow(
        unpack, "part int, first bigint, doc_id bigint, at bigint, n_tokens bigint, tokens binary")


def with_starts(rows: DataFrame, folder: str) -> DataFrame:
    """Adds ``start``, the ids of all documents before; take what is needed of ``tokens`` first."""
    starts = rows.sparkSession.read.parquet(f"{folder}/starts")
    return rows.join(starts, ["part", "first"]).withColumn("start", F.col("start") + F.col("at")).drop("part", "first", "at")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``docs`` to the shared folder in the format, reads them back, and digests them."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write(docs, folder, path)
    rows = read(spark, folder).select("part", "first", "doc_id", "at", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
    return with_starts(rows, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
