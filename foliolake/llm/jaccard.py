"""Self-join on the Jaccard similarity of word 5-grams, exact at every size.

* One scan reduces each text to its set of 64-bit shingle hashes.  Documents with equal sets (by a 128-bit digest)
  become a class with one representative; only representatives are compared.
* The same scan counts shingles in a sketch of fixed size, so that a global order can put frequent shingles last.  Two
  sets with the wanted similarity share a shingle among the first fifth of the larger and the first ninth of the smaller
  (prefix filtering holds for any order).  Postings of those prefixes are packed by hash bucket.
* In a bucket, representatives that share a prefix shingle form tiles, banded by set size: a pair is only looked at when
  sizes allow the similarity.  Small tiles give all such pairs.  A large tile first gives pairs with a few heads of each
  band only; once those are verified and joined to components, a second round looks at all pairs of large tiles that lie
  in different components still, so groups of near copies are not expanded and no connection is lost; tiles within one
  component are told before, and their postings not shipped again.  Tiles of more than
  ``TILE`` members are cut into blocks then, whose pairs are dealt over tasks.
* Hashed bitmap signatures bound the overlap of a pair from above by bit counts, in the second round inside the tile;
  survivors meet as sorted arrays and are intersected exactly.

Cases: texts with fewer than five words have their whole word sequence as one shingle; null, empty and white-space texts
have an empty set and link with nothing; a row without ``doc_id`` links with nothing and has no component; equal rows
share a class; ``doc_id`` names a document, so one whose rows hold different texts is linked by any of them; very long
texts are hashed whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, discard, filter_of, written
from .components import components
from .shingles import Words, distinct, runs

#: Counters of the sketch and of its blocks; tiles above this many members take two rounds, the first with so many heads.
CELLS, BLOCK, SMALL, HEADS = 1 << 20, 1 << 15, 16, 8
#: Members of a block of a tile in the second round; it doubles while more than CUT tiles are above it, which bounds what is shipped.
TILE, CUT = 4096, 1 << 20
#: Postings, with their signatures, that a task holds before it hands them on.
FLUSH_BYTES = 16 << 20
#: Bytes of large tiles that the driver takes at a time, about.
GATHER_BYTES = 4 << 20


def shingle_set(words: Words, text: str | None, n: int = 5) -> np.ndarray:
    return distinct(runs(words.of(text), n))


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def summarise(docs: DataFrame, n: int) -> DataFrame:
    """Rows ``doc_id, size, h1, h2`` for documents, and with ``block`` set the sketch of a task."""

    def run(batches):
        def count(sets):
            sketch[:] += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS).astype(np.uint32) if sets else np.uint32(0)

        words, sketch = Words(), np.zeros(CELLS, dtype=np.uint32)
        for b in batches:
            size, h1, h2, held, waiting = [], [], [], [], 0
            for t in b.column(1):
                s = shingle_set(words, t.as_py(), n)
                size.append(len(s))
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                h1.append(int(digest[0]))
                h2.append(int(digest[1]))
                held.append(s)
                waiting += len(s)
                if waiting > 200_000:
                    count(held)
                    held, waiting = [], 0
            count(held)
            empty = pa.nulls(len(size))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), empty.cast(pa.int32()), empty.cast(pa.binary())], names)
        for k in range(CELLS // BLOCK):
            part = sketch[k * BLOCK : (k + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1).cast(pa.int64())] * 4 + [pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)

    names = ["doc_id", "size", "h1", "h2", "block", "counts"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, h1 long, h2 long, block int, counts binary")


def frequent(summary: DataFrame) -> bytes:
    """By sketch cell, 0 for usual counts and else a class that grows with the logarithm: CELLS bytes."""

    def add(key, table):
        total = np.zeros(BLOCK, dtype=np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    cells = np.zeros(CELLS, dtype=np.int64)
    parts = summary.filter("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    for r in parts:  # CELLS / BLOCK rows
        cells[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    # What a cell holds beyond the mean, in units well above the spread of cells that share evenly.
    mean = cells.sum() / CELLS
    beyond = (cells - mean) / (3 * np.sqrt(mean) + 4)
    return np.where(beyond > 1, np.log2(np.maximum(beyond, 1)) + 1, 0).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, classes: bytes, n: int) -> DataFrame:
    """``doc_id, size, short, prefix``: the first tokens of each set in the global order; the first ``short`` of them serve it as the smaller set."""

    def run(batches):
        words, rank = Words(), np.frombuffer(classes, np.uint8)
        for b in batches:
            out = [[], [], [], []]
            for doc, t in zip(b.column(0), b.column(1)):
                s = shingle_set(words, t.as_py(), n)
                if len(s):
                    longest = len(s) - -(-4 * len(s) // 5) + 1
                    c = rank[_cell(s)]
                    if c.any():
                        s = s[np.argsort(c, kind="stable")]
                    for o, v in zip(out, (doc.as_py(), len(s), len(s) - -(-8 * len(s) // 9) + 1, s[:longest].tobytes())):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "size", "short", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, short long, prefix binary")


POSTING = np.dtype([("token", "<u8"), ("id", "<i8"), ("size", "<i4"), ("short", "<i4")])
#: Of the second round; ``before`` is the token just before in the prefix, 0 for the first; ``tile`` the token, or of a tile in blocks a pair of them, of which ``side`` 1 and 2 are to meet (0: one block); ``cut`` is 1 for tiles in blocks; ``of`` is the place of the signature.
KNOWN = np.dtype([*POSTING.descr, ("component", "<i8"), ("before", "<u8"), ("tile", "<u8"), ("side", "<i2"), ("cut", "<i2"), ("of", "<i4")])
#: A large tile's token and its members.
LARGE = np.dtype([("token", "<u8"), ("n", "<i8")])
#: A tile's token, its members, and the least and the greatest of their components.
SPAN = np.dtype([*LARGE.descr, ("low", "<i8"), ("high", "<i8")])


def in_blocks(rows: np.ndarray, tiles: np.ndarray, block: int) -> np.ndarray:
    """Postings of tiles in ``tiles`` (sorted by token) once for each pair of blocks that theirs is part of."""
    rows["tile"] = rows["token"]
    if not len(tiles) or not len(rows):
        return rows
    at = np.minimum(np.searchsorted(tiles["token"], rows["token"]), len(tiles) - 1)
    cut = np.where(tiles["token"][at] == rows["token"], -(-tiles["n"][at] // block), 1)
    of = np.repeat(np.arange(len(rows)), cut)
    total, other = cut[of], np.arange(len(of)) - np.repeat(np.cumsum(cut) - cut, cut)
    rows = rows[of]
    with np.errstate(over="ignore"):
        own = ((rows["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % total.astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(own, other), np.maximum(own, other)
        rows["cut"] = total > 1
        rows["side"] = np.where(low == high, 0, np.where(own == low, 1, 2))
        rows["tile"] ^= np.where(total > 1, (low * total + high + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
    return rows


def bucketed(prefix: DataFrame, buckets: int, only: bytes | None = None, tiles: np.ndarray | None = None, block: int = TILE) -> DataFrame:
    """``bucket, postings, signatures``: each task packs the postings of its rows by bucket.

    With ``only``, a filter of tokens, the rows have a ``component`` and a ``signature``, which go along, the signature
    once for a bucket and not with each posting; ``tiles`` are the tiles above ``block`` then.
    """

    kind = POSTING if only is None else KNOWN

    def run(batches):
        keep = None if only is None else Filter(only)
        held, bits, size = [], [], 0  # the last in bytes

        def flush():
            rows = np.concatenate(held)
            bucket = (rows["token" if only is None else "tile"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            along = []
            for part in np.split(rows, cuts):  # views of rows
                if only is not None:
                    of, part["of"] = np.unique(part["of"], return_inverse=True)
                along.append(None if only is None else b"".join([bits[k] for k in of]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts])], pa.int64()), pa.array([p.tobytes() for p in np.split(rows, cuts)], pa.binary()), pa.array(along, pa.binary())], ["bucket", "postings", "signatures"])

        for b in batches:
            ids, sizes, shorts = (b.column(k).to_numpy() for k in ("doc_id", "size", "short"))
            for k, tokens in enumerate(b.column("prefix")):
                tokens = np.frombuffer(tokens.as_py(), np.uint64)
                rows = np.zeros(len(tokens), dtype=kind)
                rows["token"], rows["id"], rows["size"] = tokens, ids[k], sizes[k]
                rows["short"][: shorts[k]] = 1
                if keep is not None:
                    rows["component"] = b.column("component")[k].as_py()
                    rows["before"][1:] = tokens[:-1]
                    rows = in_blocks(rows[keep.has(tokens)], tiles, block)
                    if len(rows):
                        rows["of"] = len(bits)
                        bits.append(b.column("signature")[k].as_py())
                        size += min(len(rows), buckets) * len(bits[-1])
                if len(rows):
                    held.append(rows)
                    size += rows.nbytes
                if size > FLUSH_BYTES:
                    yield flush()
                    held, bits, size = [], [], 0
        if held:
            yield flush()

    return prefix.mapInArrow(run, "bucket long, postings binary, signatures binary")


def _spans(rows: np.ndarray) -> np.ndarray:
    """SPAN rows folded to one for each token."""
    if not len(rows):
        return rows
    rows = rows[np.argsort(rows["token"], kind="stable")]
    starts = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
    out = rows[starts]
    out["n"], out["low"], out["high"] = (f.reduceat(rows[c], starts) for f, c in ((np.add, "n"), (np.minimum, "low"), (np.maximum, "high")))
    return out


def apart(known: DataFrame, buckets: int, only: bytes) -> DataFrame:
    """``large``: packed LARGE rows of the large tiles whose members lie in different components, the only ones that the second round has to read.

    Each task hands on one row for each token that it holds, so a tile of any size costs a task one row.
    """

    def run(batches):
        def flush():
            rows = _spans(np.concatenate(held))
            bucket = (rows["token"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts])], pa.int64()), pa.array([p.tobytes() for p in np.split(rows, cuts)], pa.binary())], ["bucket", "spans"])

        keep, held, size = Filter(only), [], 0
        for b in batches:
            for tokens, component in zip(b.column(0), b.column(1).to_pylist()):
                tokens = np.frombuffer(tokens.as_py(), np.uint64)
                tokens = tokens[keep.has(tokens)]
                if not len(tokens):
                    continue
                rows = np.zeros(len(tokens), dtype=SPAN)
                rows["token"], rows["n"], rows["low"], rows["high"] = tokens, 1, component, component
                held.append(rows)
                size += rows.nbytes
                if size > FLUSH_BYTES:
                    held = [_spans(np.concatenate(held))]
                    size = held[0].nbytes
                    if size > FLUSH_BYTES // 2:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def fold(key, table):
        rows = _spans(np.concatenate([np.frombuffer(x.as_py(), SPAN) for x in table.column("spans")]))
        rows = rows[(rows["n"] > SMALL) & (rows["low"] < rows["high"])]
        out = np.zeros(len(rows), dtype=LARGE)
        out["token"], out["n"] = rows["token"], rows["n"]
        return pa.table({"large": pa.array([out.tobytes()] if len(out) else [], pa.binary())})

    return known.select("prefix", "component").mapInArrow(run, "bucket long, spans binary").groupBy("bucket").applyInArrow(fold, "large binary")


def holding(prefix: DataFrame, only: bytes) -> DataFrame:
    """``id`` of the documents with a token of the filter in their prefix."""

    def run(batches):
        keep = Filter(only)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([bool(keep.has(np.frombuffer(t.as_py(), np.uint64)).any()) for t in b.column(1)], pa.bool_()))], ["id"])

    return prefix.select("doc_id", "prefix").mapInArrow(run, "id long")


def _tiles(table, kind: np.dtype):
    """The postings of a bucket, those of one tile together and by size, and the signatures that their ``of`` counts (none without)."""
    parts, bits = [np.frombuffer(x.as_py(), kind) for x in table.column("postings")], []
    if kind is KNOWN:
        for k, packed in enumerate(table.column("signatures")):
            _, first = np.unique(parts[k]["of"], return_index=True)
            ends = np.cumsum([signature_bytes(n) for n in parts[k]["size"][first].tolist()])
            parts[k] = parts[k].copy()
            parts[k]["of"] += len(bits)
            bits += np.split(np.frombuffer(packed.as_py(), np.uint8), ends[:-1])
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows["id"], rows["size"], rows["tile" if kind is KNOWN else "token"]))], bits


def _once(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The pairs as rows of two, the smaller id first, each once."""
    if not found:
        return np.zeros((0, 2), np.int64)
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]], axis=1)


class _Pairs:
    """Pairs that are folded to each once whenever they have doubled, so that those met many times take little memory."""

    def __init__(self, least: int = 500_000):
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.limit, self.least = 0, least, least

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.found.append((a, b))
            self.held += len(a)
        if self.held > self.limit:
            self.once()

    def once(self) -> np.ndarray:
        both = _once(self.found)
        self.found, self.held = [(both[:, 0], both[:, 1])], len(both)
        self.limit = max(self.least, 2 * len(both))
        return both


def _dealt(pairs: np.ndarray, parts: int) -> pa.Table:
    """Rows ``part, pairs``: pairs packed by a hash of both ids, so that no id makes a part large."""
    with np.errstate(over="ignore"):
        mixed = pairs.astype(np.uint64) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
        part = ((mixed[:, 0] ^ (mixed[:, 1] >> np.uint64(7))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    pairs, part = pairs[order], part[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    packed = [x.tobytes() for x in np.split(pairs, starts[1:])] if len(starts) else []
    return pa.table({"part": pa.array(part[starts], pa.int64()), "pairs": pa.array(packed, pa.binary()), "large": pa.nulls(len(starts)).cast(pa.binary())})


def unpacked(found: DataFrame) -> DataFrame:
    """``a, b``: the pairs of all buckets, each once."""

    def once(key, table):
        both = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in table.column("pairs")])
        both = _once([(both[:, 0], both[:, 1])])
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return found.filter("pairs IS NOT NULL").select("part", "pairs").groupBy("part").applyInArrow(once, "a long, b long")


def first_round(parts: int, table):
    """Pairs of small tiles, pairs with the band heads of large ones, and the large tiles' tokens."""
    rows, _ = _tiles(table, POSTING)
    token, size, found = rows["token"], rows["size"].astype(np.int64), _Pairs()
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    counts = np.diff(np.append(starts, len(rows)))
    large = np.repeat(counts > SMALL, counts)
    small = np.flatnonzero(~large)
    for k in range(1, SMALL):
        i, j = small[:-k], small[k:]
        fit = (token[i] == token[j]) & (5 * size[i] >= 4 * size[j]) & (rows["short"][i] == 1) if len(i) else np.zeros(0, bool)
        if not len(i) or not (token[i] == token[j]).any():
            break
        found.add(rows["id"][i[fit]], rows["id"][j[fit]])
    for start, count in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist()):
        head = start
        while head < start + count:
            end = start + int(np.searchsorted(size[start : start + count] * 4, size[head] * 5, side="right"))
            band = rows[head:end]
            # The same few documents lead in all tiles that they are in.
            for i in np.argsort(band["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:HEADS]:
                smaller = np.where(np.arange(len(band)) < i, band["short"], band["short"][i])
                other = np.flatnonzero((smaller == 1) & (np.arange(len(band)) != i))
                found.add(np.full(len(other), band["id"][i]), band["id"][other])
            head = end
    out = _dealt(found.once(), parts)
    if (counts > SMALL).any():
        out = pa.concat_tables([out, pa.table({"part": pa.nulls(1).cast(pa.int64()), "pairs": pa.nulls(1).cast(pa.binary()), "large": pa.array([_large(token[starts], counts).tobytes()], pa.binary())})])
    return out


def _large(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(int((counts > SMALL).sum()), dtype=LARGE)
    out["token"], out["n"] = tokens[counts > SMALL], counts[counts > SMALL]
    return out


def second_round(parts: int, table):
    """Pairs of large tiles that lie in different components and whose signatures allow the similarity.

    Two sets that also share the token before meet in its tile: there in the first round or, if large, in this one.
    """
    rows, bits = _tiles(table, KNOWN)
    tiles, size, found = rows["tile"], rows["size"].astype(np.int64), _Pairs()
    starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
    counts = np.diff(np.append(starts, len(rows)))
    for start, count in zip(starts.tolist(), counts.tolist()):
        tile = rows[start : start + count]
        sides = bool(tile["side"][0])
        # The filter lets small tiles through as well, which the first round has done; blocks are of large ones.
        if (not sides and count <= SMALL and not tile["cut"].any()) or (tile["component"] == tile["component"][0]).all():
            continue
        s = size[start : start + count]
        ends = np.searchsorted(s * 4, s * 5, side="right")
        width = np.array([signature_bytes(n) for n in s])
        # A band's signatures have at most two sizes; each size as a matrix.
        stacked = {w: (np.flatnonzero(width == w), np.stack([bits[k] for k in tile["of"][width == w]])) for w in np.unique(width)}
        for i in np.flatnonzero(tile["short"] == 1):
            for w, (members, matrix) in stacked.items():
                low, high = np.searchsorted(members, [i + 1, ends[i]])
                near = members[low:high]
                apart = (tile["component"][near] != tile["component"][i]) & (not sides or tile["side"][near] != tile["side"][i])
                at = low + np.flatnonzero(apart & ((tile["before"][near] != tile["before"][i]) | (tile["before"][i] == 0)))
                for k in range(0, len(at), 4096):
                    other = members[at[k : k + 4096]]
                    most = most_shared(bits[tile["of"][i]], s[i], matrix[at[k : k + 4096]], s[other])
                    other = other[100 * most >= 80 * (s[i] + s[other] - most)]
                    found.add(np.full(len(other), tile["id"][i]), tile["id"][other])
    return _dealt(found.once(), parts)


def signature_bytes(n: int) -> int:
    """At least four bits an element up to 32 kB, a power of two."""
    return 1 << min(15, max(3, int(4 * n - 1).bit_length() - 3))


def signature(s: np.ndarray) -> np.ndarray:
    bits = 8 * signature_bytes(len(s))
    out = np.zeros(bits, dtype=np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def _folded(a: np.ndarray, width: int) -> np.ndarray:
    while a.shape[-1] > width:
        a = a[..., : a.shape[-1] // 2] | a[..., a.shape[-1] // 2 :]
    return a


def most_shared(a: np.ndarray, n_a, b: np.ndarray, n_b):
    """No more elements than this are in both sets: every bit of one alone stands for an element that the other lacks.  ``b``: one signature or rows of them."""
    width = min(a.shape[-1], b.shape[-1])
    a, b = _folded(a, width), _folded(b, width)
    return np.minimum(n_a - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))


def sets_of(docs: DataFrame, ids: DataFrame, n: int, tokens: bool) -> DataFrame:
    """``id, size`` and ``data``, the tokens or else the signature, of the documents in ``ids`` (one long column) and of few others: a filter of fixed size keeps their texts from being hashed, and no text or set is shuffled for it."""

    packed = docs.sparkSession.sparkContext.broadcast(filter_of(ids).packed())

    def run(batches):
        want, words = Filter(packed.value), Words()
        for b in batches:
            # A null id is taken for -1, which no join below finds.
            at = np.flatnonzero(want.has(b.column(0).fill_null(-1).to_numpy()))
            for k in range(0, len(at), 500):
                rows = b.take(pa.array(at[k : k + 500]))
                sets = [shingle_set(words, t.as_py(), n) for t in rows.column(1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([(s if tokens else signature(s)).tobytes() for s in sets], pa.binary())], ["id", "size", "data"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, size long, data binary")


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda name: sets.select(F.col("id").alias(name), F.col("data").alias(f"of_{name}"), F.col("size").alias(f"n_{name}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def bounded(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures allow the similarity 0.8."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y, n, m in zip(*(b.column(k) for k in ("of_a", "of_b", "n_a", "n_b"))):
                n, m = n.as_py(), m.as_py()
                most = most_shared(np.frombuffer(x.as_py(), np.uint8), n, np.frombuffer(y.as_py(), np.uint8), m)
                keep.append(bool(100 * most >= 80 * (n + m - most)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _met(pairs, signatures).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs ``a, b`` with at least the similarity 0.8.  Only now are sets made, of the documents that are left."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("of_a"), b.column("of_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = written(sets_of(docs, ids_of(pairs), n, tokens=True), "sets")
    links = written(_met(pairs, sets).mapInArrow(run, "a long, b long").distinct(), "links")
    discard(sets)
    return links


def gathered(packed: DataFrame, block: int) -> tuple[bytes | None, np.ndarray, int]:
    """Of the LARGE rows in ``large``: a filter of the tokens (None without rows), the tiles above a block by token, and the block's members."""
    tokens, tiles, any_ = Filter(), np.zeros(0, LARGE), False
    size = packed.agg(F.sum(F.octet_length("large"))).first()[0] or 0
    # Some megabytes at a time, into a filter of fixed size; a job for each bucket would load the driver.
    for r in packed.select("large").coalesce(1 + size // GATHER_BYTES).toLocalIterator():
        one = np.frombuffer(bytes(r.large), LARGE)
        tokens.add(one["token"])
        tiles, any_ = np.concatenate([tiles, one[one["n"] > block]]), True
        while len(tiles) > CUT:
            block *= 2
            tiles = tiles[tiles["n"] > block]
    return tokens.packed() if any_ else None, np.sort(tiles, order="token"), block


def similar(docs: DataFrame, n: int = 5, bucket_bytes: int = 18 << 20, tile: int = TILE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    spark = docs.sparkSession
    summary = written(summarise(docs, n), "summary")
    base = summary.filter("block IS NULL").select("doc_id", "size", "h1", "h2")
    classes = frequent(summary)
    filled = base.filter("size > 0 AND doc_id IS NOT NULL")
    heads = filled.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("head"))
    prefix = prefixes(docs, classes, n).join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_semi")
    prefix = written(prefix.dropDuplicates(["doc_id", "size", "prefix"]), "prefix")
    # A document with several texts joins their classes.
    several = filled.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("doc_id")
    of_several = filled.join(several, "doc_id", "left_semi").join(heads, ["h1", "h2", "size"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    of_several = written(of_several, "several")
    postings = prefix.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(postings * POSTING.itemsize // bucket_bytes) + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)

    def met(postings, round_):
        return postings.groupBy("bucket").applyInArrow(lambda key, table: round_(parts, table), "part long, pairs binary, large binary")

    first = written(met(bucketed(prefix, buckets), first_round), "tiles")
    pairs = written(unpacked(first), "pairs")
    large, _, _ = gathered(first.filter("large IS NOT NULL"), tile)
    signatures = written(sets_of(docs, ids_of(pairs), n, tokens=False), "signatures")
    allowed = written(bounded(pairs, signatures), "pairs")
    links = verified(allowed, docs, n).unionByName(of_several)
    found = components(links)
    if large:
        known = written(prefix.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "known")
        spans = written(apart(known, buckets, large), "apart")
        only, tiles, block = gathered(spans, tile)
        if only:
            more_signatures = written(sets_of(docs, holding(known, only), n, tokens=False), "signatures")
            signed = known.join(more_signatures.select(F.col("id").alias("doc_id"), "size", F.col("data").alias("signature")), ["doc_id", "size"]).dropDuplicates(["doc_id", "size", "prefix", "signature"])
            more = written(unpacked(met(bucketed(signed, buckets, only, tiles, block), second_round)).join(pairs, ["a", "b"], "left_anti"), "pairs")
            again = verified(more, docs, n)
            if not again.isEmpty():
                found = components(links.unionByName(again))
            for table in (more_signatures, more):
                discard(table)
        for table in (known, spans):
            discard(table)
    for table in (first, pairs, signatures, allowed, prefix):
        discard(table)
    # From representatives to all documents: their class's component.
    classes_ = heads.join(found.select(F.col("id").alias("head"), "component"), "head", "left").select("h1", "h2", "size", F.coalesce("component", "head").alias("component"))
    linked = base.join(classes_, ["h1", "h2", "size"], "left")
    return linked.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in SQL; quadratic in documents that share a shingle, so meant for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
t AS (SELECT doc_id, unnest(g) AS tok FROM s),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.tok = y.tok AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n_shingles + nb.n_shingles - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT u, u FROM (SELECT DISTINCT u FROM e) UNION SELECT e.u, r.v FROM e JOIN r ON e.v = r.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT n.doc_id, n.n_shingles, coalesce(c.component_id, n.doc_id) AS component_id FROM n LEFT JOIN c ON n.doc_id = c.u
"""
