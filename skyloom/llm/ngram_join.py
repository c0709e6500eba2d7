"""N-gram Jaccard self-join with a prefix tree, and the classes of its links.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  Two
documents link when 4 * |A & B| >= 3 * |A | B|.  Steps:

1. Sets are made once; equal sets (copies) are one *class* from here on.
2. A shingle that only one class has links nothing.  Which are shared is counted
   exactly for all shingles whose hash is in the lowest ``LOW`` share.  Of a
   class's k low shingles at most n - ceil(3n/4) are missing in a partner, so a
   class with fewer shared ones than the rest has no partner and goes.
3. For those left, the number of classes of each of their shingles gives the
   global order: rare first.  Partners share a shingle within their first
   n - ceil(3n/4) + 1; these give candidate components.
4. The sets of a component are dealt by hash into blocks of about ``BLOCK``;
   each pair of blocks is a task's group.  There the sets of one block are
   stored in a trie in the global order and those of the other traverse it:
   the overlap with a shared beginning is counted once for all sets below, and
   a subtree goes when what remains cannot reach the least overlap.
5. The links' spanning edges give components, and these the class ids.

What is shuffled in steps 2 and 3 are packed arrays of hashes, one for each
block of documents and range of hashes, never one row for each shingle.  A
shingle that very many documents have is sent at most ``HOT`` times by each
block, so no group grows with it.  No step collects sets, links or components.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A text of fewer words
has the whole sequence as its one shingle.

Edge cases: null and empty texts have the empty set and are their own
components; repeated rows are copies; a null id counts as larger than any, and
a component without an id has none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_id, dropped, small, stored, table, with_own_ids
from .components import components

WIDTH = 5
LOW = 0.35
#: Hashes of one group of a packed exchange, and of the block that a task packs at once.
GROUP, PACK = 1_500_000, 1_000_000
BLOCK = 64
SEGMENT = 64
#: Nodes of a block that have a hash before it is marked as shared instead of sent for each; the node that stands for them, and how often such a hash is said to be there.
HOT = 16
MARK = -(2**63)
OFTEN = 2**31 - 1

LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
CHUNK = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of many texts at once: rolling sums over their bytes, then over their words."""

    base = 0x2545F4914F6CDD1D
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
    steps = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(WIDTH)]

    def __init__(self):
        self.up = powers(self.base, 2 * CHUNK)
        self.down = powers(pow(self.base, -1, 1 << 64), 2 * CHUNK)

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        b = np.frombuffer(data, np.uint8)
        solid = np.concatenate([[False], b != 32, [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        first, end = edge[::2], edge[1::2]
        if len(b) > len(self.up):
            self.up, self.down = powers(self.base, 2 * len(b)), powers(pow(self.base, -1, 1 << 64), 2 * len(b))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.letters[b] * self.up[: len(b)])])
        return mixed((sums[end] - sums[first]) * self.down[first] + (end - first).astype(np.uint64) * ODD), first

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        out: list[np.ndarray] = []
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append((t or b"").translate(LOWER))
            size += len(part[-1]) + 1
            if size >= CHUNK:
                out += self.chunk(part)
                part, size = [], 0
        return out + self.chunk(part) if part else out

    def chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        hashes, first = self.word_hashes(b" ".join(texts))
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = np.searchsorted(first, bounds)
        padded = np.concatenate([hashes, np.zeros(WIDTH, np.uint64)])
        rolled = np.zeros(len(hashes), np.uint64)
        for k in range(WIDTH):
            rolled += padded[k : k + len(hashes)] * self.steps[k]
        rolled = mixed(rolled)
        out = []
        for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - a >= WIDTH:
                out.append(np.unique(rolled[a : e - WIDTH + 1]))
            elif e > a:
                out.append(mixed(np.array([sum(int(h) * int(s) for h, s in zip(hashes[a:e], self.steps)) + (e - a) & (2**64 - 1)], np.uint64)))
            else:
                out.append(hashes[:0])
        return out


def fingerprint(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def shingled(docs: DataFrame, low: float) -> DataFrame:
    """id, key, fp (of the set), n, k and ``hashes`` below ``low`` of all hashes' range, of each document."""
    limit = np.uint64(min(2**64 - 1, int(low * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingler.sets(part.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist())
                lows = [s[: np.searchsorted(s, limit, "right")] for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("key"), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in lows], pa.int64()), pa.array([s.tobytes() for s in lows], pa.binary())], ["id", "key", "fp", "n", "k", "hashes"])

    return docs.select("id", "key", "text").mapInArrow(run, "id bigint, key bigint, fp binary, n bigint, k bigint, hashes binary")


def packed(sets: DataFrame, groups: int, sizes: bool, hot: int = HOT) -> DataFrame:
    """Sets (node, n, hashes) cut by hash into ``groups``: one row for each block of sets and group.

    A block has each node once, so copies are combined before the shuffle.  A hash that ``hot`` nodes of a
    block have is known to be shared: its group gets it once from the block, with the node ``MARK``, however
    many nodes there are.  These nodes' hot hashes (with ``sizes``; else how many they are) go to the groups
    from ``groups`` on, by node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[int, np.ndarray]] = {}
        size = 0

        def rows(base: int, group: np.ndarray, hashes: np.ndarray, owner: np.ndarray, nodes: np.ndarray, ns: np.ndarray, whole: bool = True):
            """A row for each group of the (hash, owner) pairs, which are in the order of their owners."""
            order = np.argsort(group, kind="stable")
            hashes, owner, group = hashes[order], owner[order], group[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            for a, e in zip(first.tolist(), [*first[1:].tolist(), len(group)]):
                who, counts = np.unique(owner[a:e], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([base + int(group[a])], pa.int32()), pa.array([nodes[who].tobytes()], pa.binary()), pa.array([ns[who].tobytes() if sizes else b""], pa.binary()),
                    pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([hashes[a:e].tobytes() if whole else b""], pa.binary())], ["g", "nodes", "ns", "counts", "hashes"])

        def flush():
            hashes = np.concatenate([h for _, h in own.values()])
            owner = np.repeat(np.arange(len(own)), [len(h) for _, h in own.values()])
            nodes, ns = np.array([*own, MARK], np.int64), np.array([*(n for n, _ in own.values()), 0], np.int32)
            order = np.argsort(hashes)
            first = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])[: len(hashes)])
            times = np.diff(first, append=len(hashes))
            many = np.zeros(len(hashes), bool)
            many[order] = np.repeat(times >= hot, times)
            marked = hashes[order[first[times >= hot]]]
            rest, its = np.concatenate([hashes[~many], marked]), np.concatenate([owner[~many], np.full(len(marked), len(own))])
            yield from rows(0, (mixed(rest) % np.uint64(groups)).astype(np.int32), rest, its, nodes, ns)
            if len(marked):
                yield from rows(groups, (nodes[owner[many]] % groups).astype(np.int32), hashes[many], owner[many], nodes, ns, sizes)

        for batch in batches:
            for i, n, h in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("hashes")):
                if i not in own:
                    own[i] = (n, np.frombuffer(h.as_py(), np.uint64))
                    size += len(own[i][1]) + 4
                if size >= PACK:
                    yield from flush()
                    own, size = {}, 0
        if own:
            yield from flush()

    return sets.select("node", "n", "hashes").mapInArrow(run, "g int, nodes binary, ns binary, counts binary, hashes binary")


def column(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a group and their sizes; the distinct (hash, class) pairs, by hash, of hashes
    that several classes have, and how many those are."""
    every, ns = column(rows, "nodes", np.int64), column(rows, "ns", np.int32)
    counts, hashes = column(rows, "counts", np.int32), column(rows, "hashes", np.uint64)
    nodes, first, ids = np.unique(every, return_index=True, return_inverse=True)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    same = hashes[1:] == hashes[:-1]
    some = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    # most hashes are there once and go
    hashes, owner = hashes[some], np.repeat(ids.astype(np.int32), counts)[order[some]]
    run = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]) - 1
    order = np.argsort(run * len(nodes) + owner, kind="stable")
    hashes, owner, run = hashes[order], owner[order], run[order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
    hashes, owner, run = hashes[new], owner[new], run[new]
    df = np.bincount(run, minlength=1)[run] if len(run) else run
    return nodes, ns[first] if len(ns) else ns, hashes[df > 1], owner[df > 1], df[df > 1]


def shared_counts(sets: DataFrame, groups: int, hot: int = HOT) -> DataFrame:
    """node and ``c``: how many of its hashes other classes have too (no row: none).

    Of a class with copies in several blocks a hot hash may count twice, never less than once: of its hot ones
    in each block the most count, and the others where they meet the mark.
    """

    def count(rows: pa.Table) -> pa.Table:
        if rows.column("g")[0].as_py() >= groups:
            every = column(rows, "nodes", np.int64)
            nodes, ids = np.unique(every, return_inverse=True)
            c = np.zeros(len(nodes), np.int64)
            np.maximum.at(c, ids, column(rows, "counts", np.int32))
        else:
            nodes, _, _, owner, _ = unpacked(rows)
            c = np.bincount(owner, minlength=len(nodes))
            some = (c > 0) & (nodes != MARK)
            nodes, c = nodes[some], c[some]
        part = nodes % groups
        order = np.argsort(part, kind="stable")
        nodes, c = nodes[order], c[order]
        parts, at = np.unique(part[order], return_index=True)
        ends = [*at[1:], len(nodes)]
        return pa.table({
            "p": pa.array(parts, pa.int64()), "nodes": pa.array([nodes[a:e].tobytes() for a, e in zip(at, ends)], pa.binary()),
            "c": pa.array([c[a:e].tobytes() for a, e in zip(at, ends)], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        nodes, ids = np.unique(column(rows, "nodes", np.int64), return_inverse=True)
        c = np.bincount(ids, column(rows, "c", np.int64), len(nodes))
        return pa.table({"node": pa.array(nodes, pa.int64()), "c": pa.array(c.astype(np.int64), pa.int64())})

    each = packed(sets, groups, False, hot).groupBy("g").applyInArrow(count, "p bigint, nodes binary, c binary")
    return each.groupBy("p").applyInArrow(add, "node bigint, c bigint")


def ordered(sets: DataFrame, groups: int, hot: int = HOT) -> DataFrame:
    """node, n, ``hashes`` that other classes have too, in the global order, their ``dfs``, and ``prefix``,
    those of the first n - ceil(3n/4) + 1.  Classes without any in there are left out.

    A hash that is hot in any block is ``OFTEN`` there for all classes, so the order is the same everywhere.
    """

    def find(rows: pa.Table) -> pa.Table:
        if rows.column("g")[0].as_py() >= groups:
            nodes, ns, hashes = column(rows, "nodes", np.int64), column(rows, "ns", np.int32), column(rows, "hashes", np.uint64)
            owner = np.repeat(np.arange(len(nodes)), column(rows, "counts", np.int32))
            df = np.full(len(hashes), OFTEN, np.int32)
        else:
            nodes, ns, hashes, owner, df = unpacked(rows)
            often = np.zeros(0, np.uint64)
            if len(nodes) and (at := int(np.searchsorted(nodes, MARK))) < len(nodes) and nodes[at] == MARK:
                often = hashes[owner == at]
                hashes, owner, df = hashes[owner != at], owner[owner != at], df[owner != at]
            df = np.where(np.isin(hashes, often), OFTEN, df).astype(np.int32)
            order = np.argsort(owner, kind="stable")
            hashes, owner, df = hashes[order], owner[order], df[order]
        who = np.unique(owner)
        a, e = np.searchsorted(owner, who), np.searchsorted(owner, who, "right")
        return pa.table({
            "node": pa.array(nodes[who], pa.int64()), "n": pa.array(ns[who], pa.int64()),
            "h": pa.array([hashes[x:y].tobytes() for x, y in zip(a, e)], pa.binary()), "d": pa.array([df[x:y].tobytes() for x, y in zip(a, e)], pa.binary())})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                h = np.frombuffer(b"".join(x["h"] for x in r["parts"]), np.uint64)
                d = np.frombuffer(b"".join(x["d"] for x in r["parts"]), np.int32)
                h, first = np.unique(h, return_index=True)  # a class may be in several blocks
                d, n = d[first], r["n"]
                reach = n - (3 * n + 3) // 4 + 1 - (n - len(h))  # hashes of one class come first
                if reach > 0:
                    order = np.lexsort((h, d))
                    h, d = h[order], d[order]
                    out.append({"node": r["node"], "n": n, "hashes": h.tobytes(), "dfs": d.tobytes(), "prefix": h[:reach].view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("dfs", pa.binary()), ("prefix", pa.list_(pa.int64()))]))

    each = packed(sets, groups, True, hot).groupBy("g").applyInArrow(find, "node bigint, n bigint, h binary, d binary")
    whole = each.groupBy("node", "n").agg(F.collect_list(F.struct("h", "d")).alias("parts"))  # of one class: its own set
    return whole.mapInArrow(sort, "node bigint, n bigint, hashes binary, dfs binary, prefix array<bigint>")


#: A class's number: the first eight bytes of its fingerprint.
NODE = "cast(conv(hex(substr(fp, 1, 8)), 16, -10) as bigint)"


class Trie:
    """Sets as ascending rank arrays, stored by shared beginnings; edges are cut into segments."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        own = [sets[i] for i in order]
        lcp = [0]
        for a, b in zip(own, own[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            lcp.append(int(differ[0]) if len(differ) else m)
        tokens, filled = [], 0
        # by level: first token, end, last rank, least size of a set below, most tokens left, parent, sets that end here
        self.levels: list[tuple[np.ndarray, ...]] = []
        level = [(0, len(own), 0, -1)]
        while level:
            nodes, below = [], []
            for lo, hi, depth, parent in level:
                # sets lo..hi share their first ``depth`` tokens; they go on alike up to ``cut``
                end = min([len(own[lo])] + lcp[lo + 1 : hi]) if hi - lo > 1 else len(own[lo])
                cut = min(end, depth + SEGMENT)
                tokens.append(own[lo][depth:cut])
                start, filled = filled, filled + cut - depth
                ends = [k for k in range(lo, hi) if len(own[k]) == cut]
                rest = [k for k in range(lo, hi) if len(own[k]) > cut]
                mine = len(nodes)
                nodes.append((start, filled, int(own[lo][cut - 1]) if cut else -1, int(sizes[[order[k] for k in range(lo, hi)]].min()), max(len(own[k]) for k in range(lo, hi)) - cut, parent, [order[k] for k in ends]))
                k = rest[0] if rest else hi
                while k < hi:
                    e = k + 1
                    while e < hi and lcp[e] > cut:
                        e += 1
                    below.append((k, e, cut, mine))
                    k = e
            self.levels.append(tuple(np.array([x[c] for x in nodes], np.int64) for c in range(6)) + ([x[6] for x in nodes],))
            level = below
        self.tokens = np.concatenate(tokens) if tokens else np.empty(0, np.int64)

    def probe(self, own: np.ndarray, size: int, width: int) -> list[int]:
        """Sets that link to ``own``, ascending ranks of a set of ``size`` in all."""
        has = np.zeros(width, np.int64)
        has[own] = 1
        alive, overlap, found = None, None, []
        for first, end, last, least, left, parent, ends in self.levels:
            if alive is None:
                here, before = np.arange(len(first)), np.zeros(len(first), np.int64)
            else:
                here = np.flatnonzero(alive[parent])
                before = overlap[parent[here]]
            if not len(here):
                break
            a, n = first[here], end[here] - first[here]
            starts = np.cumsum(n) - n
            where = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(a, n)
            hits = np.concatenate([[0], np.cumsum(has[self.tokens[where]])])
            now = before + hits[starts + n] - hits[starts]
            rest = np.minimum(left[here], len(own) - np.searchsorted(own, last[here], "right"))
            go = 7 * (now + rest) >= 3 * (size + least[here])
            alive, overlap = np.zeros(len(first), bool), np.zeros(len(first), np.int64)
            alive[here], overlap[here] = go, now
            for k, o in zip(here[go].tolist(), now[go].tolist()):
                found += [s for s in ends[k] if 7 * o >= 3 * (size + int(self.sizes[s]))]
        return found


def spanning(nodes: list[int], links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked node with the least that it reaches."""
    up = {n: n for n in nodes}

    def top(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return [(n, top(n)) for n in nodes if top(n) != n]


def block_links(rows: pa.Table) -> list[tuple[int, int]]:
    """Links between the blocks of a group (node, n, b, hashes, dfs), as edges that span its components; within it, if there is one block."""
    own: dict[int, dict] = {r["node"]: r for r in rows.to_pylist()}
    keys = list(own)
    hashes = [np.frombuffer(own[k]["hashes"], np.uint64) for k in keys]
    dfs = [np.frombuffer(own[k]["dfs"], np.int32) for k in keys]
    h, d = np.concatenate(hashes), np.concatenate(dfs)
    order = np.lexsort((h, d))
    ranks = np.empty(len(h), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[False], (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])]))
    cuts = np.cumsum([0] + [len(x) for x in hashes])
    sets = [ranks[a:e] for a, e in zip(cuts[:-1], cuts[1:])]
    sizes = np.array([own[k]["n"] for k in keys], np.int64)
    blocks = sorted({own[k]["b"] for k in keys})
    stored_ = [i for i, k in enumerate(keys) if own[k]["b"] == blocks[0]]
    probing = [i for i, k in enumerate(keys) if own[k]["b"] == blocks[-1]]
    trie = Trie([sets[i] for i in stored_], sizes[stored_])
    width = int(ranks.max()) + 1

    def links():
        for i in probing:
            for j in trie.probe(sets[i], int(sizes[i]), width):
                if stored_[j] != i:
                    yield keys[i], keys[stored_[j]]

    return spanning(keys, links())


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that span all components of ``ordered`` sets."""
    post = stored(sets.select("node", F.explode("prefix").alias("h")), "postings")
    hubs = stored(post.groupBy("h").agg(F.min("node").alias("hub")), "hubs")
    # Each class takes the least class it shares a prefix shingle with; what is left to join are those.
    first = stored(post.join(hubs, "h").groupBy("node").agg(F.min("hub").alias("one")), "first")
    dropped(hubs)
    ones = stored(post.join(first, "node").select("h", "one").distinct(), "ones")
    dropped(post)
    least = stored(ones.groupBy("h").agg(F.min("one").alias("least"), F.count("*").alias("m")).where("m > 1").select("h", "least"), "least")
    rest = ones.join(least, "h").where("one <> least").select(F.col("one").alias("a"), F.col("least").alias("b")).distinct()
    near = components(first.select(F.col("node").alias("a"), F.col("one").alias("b")).unionByName(rest))
    sizes = near.groupBy("label").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = near.join(stored(sizes, "sizes"), "label").withColumn("b", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = stored(dealt.select("node", "label", "blocks", "b"), "dealt")
    pairs = dealt.join(sets.select("node", "n", "hashes", "dfs"), "node").withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = pairs.select("label", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "node", "n", "b", "hashes", "dfs")

    def run(rows: pa.Table) -> pa.Table:
        found = block_links(rows)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return pairs.groupBy("label", "i", "j").applyInArrow(run, "a bigint, b bigint")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    low = stored(shingled(docs, LOW), "shingles")
    total = low.agg(F.sum("k")).first()[0] or 0
    shared = shared_counts(low.where("n > 0").withColumn("node", F.expr(NODE)), total // GROUP + 1, hot)
    classes = stored(low.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("key"), F.max("n").alias("n"), F.max("k").alias("k")).withColumn("node", F.expr(NODE)), "classes")
    # k low hashes, of which a partner lacks at most n - ceil(3n/4)
    some = classes.join(shared, "node", "left").where("coalesce(c, 0) >= k - (n - ceil(3 * n / 4))")
    some = stored(some.select("key", F.col("fp").alias("own")), "some")
    again = docs.join(small(some, 64), "key").select("own", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingler.sets(part.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist())
                keep = [(fp, s) for fp, s in zip(part.column("own").to_pylist(), sets) if fingerprint(s) == fp]
                yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in keep], pa.binary()), pa.array([len(s) for _, s in keep], pa.int64()), pa.array([s.tobytes() for _, s in keep], pa.binary())], ["fp", "n", "hashes"])

    full = stored(again.mapInArrow(whole, "fp binary, n bigint, hashes binary").withColumn("node", F.expr(NODE)), "sets")
    total = full.agg(F.sum("n")).first()[0] or 0
    sets = stored(ordered(full, total // GROUP + 1, hot), "ordered")
    dropped(full)
    groups = components(links(sets))
    named = stored(classes.join(groups, "node").select("fp", "label", "id"), "named")
    least = stored(named.groupBy("label").agg(F.min("id").alias("least")), "least")
    found = named.join(least, "label").select("fp", "least")
    component = stored(classes.join(found, "fp", "left").select("fp", F.coalesce("least", "id").alias("component")), "component")
    out = low.select("id", "n", "fp").join(component, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or not, to one with a smaller doc_id.

    Rows with the same doc_id are one document.  A null doc_id counts as larger than
    any: such a row goes if it links to one with an id, and of those that only link
    to each other one is left; equal rows without an id are one document.
    """
    return with_own_ids(docs, unique_by_id)


def unique_by_id(docs: DataFrame) -> DataFrame:
    found = joined(docs)
    gone = found.where("doc_id <> component_id").select("doc_id")
    more = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = by_id(docs, gone.distinct(), "left_anti")
    more = stored(more, "repeated")
    if not more.limit(1).count():
        return kept
    twice = by_id(kept, more, "left_semi").dropDuplicates(["doc_id"])
    return by_id(kept, more, "left_anti").unionByName(twice)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {WIDTH}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {WIDTH - 1}))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams AS a JOIN grams AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id FROM reach JOIN d ON d.doc_id = reach.x LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
