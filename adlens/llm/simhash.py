"""SimHash near-dedup: documents whose 64-bit fingerprints differ in few bits form one group.

Method: Gray-order hierarchical index. Within a block the fingerprints are sorted by Gray rank, so that
neighbours share most bits. Runs of neighbours become nodes: a node holds the bits on which all codes below
agree (mask and pattern), less those its upper node already holds. A search walks all levels down at once and
adds up, for each (code, node) pair, the differences in the node's own pattern; a pair beyond the distance is
dropped with the whole group below it. At the leaves the sum is the exact distance.

Blocks: the top nodes of the index hold the patterns under ``distance + 1`` disjoint masks. Codes within the
distance agree wholly on one of the masks, so each code is filed once under each mask, and only codes with an
equal pattern under it are compared. A block with more than ``max_block`` codes is filed again under masks of
the bits left; as those run out, a block can't hold more than 2**bits-left codes, however many documents there are.

Links needn't be listed in full: only components are asked for, so a (code, node) pair is also dropped when the
node's codes all belong to the code's component already. No link between components is lost by that.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; equal fingerprints are
one code; a null id is its own document but can't be a component's name; rows that repeat an id are documents of their
own, each with its text; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, buffers, materialize, text_key
from .graph import components

SHINGLE = 4
DISTANCE = 4
FAN = 8
PRINT = pa.schema([("doc_id", pa.int64()), ("code", pa.int64())])
LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if over half of the shingles' hashes have it."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = len(words) - shingle + 1
    starts = [0, *ends[: n - 1]]
    hash_ = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        h = np.fromiter((hash_(joined[a : b - 1], 42) for a, b in zip(starts[lo : lo + (1 << 16)], ends[lo + shingle - 1 : lo + (1 << 16) + shingle - 1], strict=False)), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("body"))
            codes = np.fromiter((fingerprint(raw[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(batch))
            yield arrow_rows(PRINT, doc_id=batch.column("doc_id"), code=codes.view(np.int64))
    return run


def _keyed_prints(shingle: int):
    """Fingerprints beside the columns that tell rows apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("body"))
            codes = np.fromiter((fingerprint(raw[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "did", "h")], pa.array(codes.view(np.int64))], names=["id", "did", "h", "code"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, code): the fingerprint of every row as a signed long."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("body"))
    return own.mapInArrow(_prints(shingle), "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, as a long to be read unsigned."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def masks(bits: list[int], n: int) -> list[list[int]]:
    """``n`` disjoint shares of ``bits``, as even as can be."""
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def as_long(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayIndex:
    """Codes in (block, Gray rank) order and the levels of nodes above them, each block with one top node."""

    def __init__(self, block: np.ndarray, code: np.ndarray):
        self.code = code
        first = np.r_[True, block[1:] != block[:-1]]
        self.block = np.cumsum(first) - 1
        # levels from the leaves up: (ones, zeros) on which all codes agree, first child, owner block
        self.levels = []
        ones, zeros, owner = code, ~code, self.block
        child = np.arange(len(code) + 1)
        while True:
            self.levels.append((ones, zeros, child, owner))
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(heads) == len(owner):
                break
            at = np.arange(len(owner)) - heads[np.cumsum(np.r_[True, owner[1:] != owner[:-1]]) - 1]
            cut = np.flatnonzero(at % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            child, owner = np.r_[cut, len(owner)], owner[cut]

    def links(self, distance: int, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs that join all codes within the distance into their components."""
        code, n = self.code, len(self.code)
        near = np.flatnonzero((self.block[1:] == self.block[:-1]) & (popcount(code[1:] ^ code[:-1]) <= distance))
        label = np.arange(n)
        pairs = [(near, near + 1)]
        label = joined(label, near, near + 1)
        spans = self.spans()
        todo = [np.arange(lo, min(lo + 1024, n)) for lo in range(0, n, 1024)]
        for q in todo:
            found = self.search(q, label, spans, distance, room)
            if len(found[0]):
                pairs.append(found)
                label = joined(label, *found)
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def spans(self) -> list[np.ndarray]:
        """For each level, the end of each node's codes."""
        ends = [np.arange(1, len(self.code) + 1)]
        for _, _, child, _ in self.levels[1:]:
            ends.append(ends[-1][child[1:] - 1])
        return ends

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the component of a node's codes if they all have one, else -1."""
        lo = hi = label
        out = [label]
        for _, _, child, _ in self.levels[1:]:
            lo, hi = np.minimum.reduceat(lo, child[:-1]), np.maximum.reduceat(hi, child[:-1])
            out.append(np.where(lo == hi, lo, -1))
        return out

    def search(self, q: np.ndarray, label: np.ndarray, spans: list[np.ndarray], distance: int, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (code of q, later code) within the distance and not yet in one component."""
        same = self.uniform(label)
        top = len(self.levels) - 1
        stack = [(top, q, self.block[q], None)]
        out_a, out_b = [], []
        code = self.code
        while stack:
            level, a, node, far = stack.pop()
            ones, zeros, child, _ = self.levels[level]
            if far is None:  # at the top node: its own pattern
                far = popcount((ones[node] & ~code[a]) | (zeros[node] & code[a]))
            keep = (far <= distance) & (spans[level][node] > a + 1) & (same[level][node] != label[a])
            a, node, far = a[keep], node[keep], far[keep]
            if not len(a):
                continue
            if level == 0:
                out_a.append(a)
                out_b.append(node)
                continue
            n_child = child[node + 1] - child[node]
            ends = np.cumsum(n_child)
            if ends[-1] > room and len(a) > 1:  # bounded memory: one half after the other
                half = len(a) // 2
                stack += [(level, a[half:], node[half:], far[half:]), (level, a[:half], node[:half], far[:half])]
                continue
            below = np.arange(ends[-1]) - np.repeat(ends - n_child - child[node], n_child)
            upper = np.repeat(node, n_child)
            a, far = np.repeat(a, n_child), np.repeat(far, n_child)
            c_ones, c_zeros = self.levels[level - 1][:2]
            # only what the node adds to its upper node's pattern
            own_ones, own_zeros = c_ones[below] & ~ones[upper], c_zeros[below] & ~zeros[upper]
            far = far + popcount((own_ones & ~code[a]) | (own_zeros & code[a]))
            stack.append((level - 1, a, below, far))
        if not out_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component after linking a[i] with b[i]; label[i] points to a lesser or equal index."""
    label = label.copy()
    while len(a):
        x, y = label[a], label[b]
        move = x != y
        if not move.any():
            break
        a, b, x, y = a[move], b[move], x[move], y[move]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _block_links(distance: int, rows: int):
    """Links of whole blocks, about ``rows`` codes at once. Rows arrive sorted by block and Gray rank."""
    def solve(block: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(block, code)
        a, b = index.links(distance)
        label = joined(np.arange(len(code)), a, b)
        moved = np.flatnonzero(label != np.arange(len(code)))
        if len(moved):  # a star from the first code of each component: as many links as joined codes
            yield arrow_rows(LINK, u=code[moved].view(np.int64), v=code[label[moved]].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, codes, held = [], [], 0
        for batch in batches:
            blocks.append(batch.column("block").to_numpy())
            codes.append(batch.column("code").to_numpy().view(np.uint64))
            held += len(batch)
            if held > rows:
                block, code = np.concatenate(blocks), np.concatenate(codes)
                other = np.flatnonzero(block != block[-1])
                cut = int(other[-1]) + 1 if len(other) else 0  # the last block may go on in the next batch
                if cut:
                    yield from solve(block[:cut], code[:cut])
                blocks, codes, held = [block[cut:]], [code[cut:]], len(block) - cut
        if held:
            yield from solve(np.concatenate(blocks), np.concatenate(codes))
    return run


def file_blocks(codes: DataFrame, bits: list[int], distance: int, max_block: int) -> list[DataFrame]:
    """(block, code) rows such that codes within the distance meet in a block; no block over ``max_block`` unless bits ran out."""
    out, level = [], 0
    # rows carry the bits that no mask has used yet, as a list index into ``open_bits``
    current, open_bits = codes.select(F.lit(0).cast("long").alias("block"), "code", F.lit("").alias("path")), {"": bits}
    while True:
        shares = {path: masks(left, distance + 1) for path, left in open_bits.items() if len(left) > distance}
        if not shares:
            out.append(current.select("block", "code"))
            return out
        options = F.array(*[
            F.struct(F.lit(path).alias("of"), F.lit(f"{path}{i}").alias("path"), F.lit(as_long(share)).alias("mask"))
            for path, part in shares.items() for i, share in enumerate(part)])
        filed = (current.withColumn("o", F.explode(F.filter(options, lambda o: o["of"] == F.col("path"))))
                 .select(F.xxhash64("block", "o.path", F.col("code").bitwiseAND(F.col("o.mask"))).alias("block"), "code", "o.path"))
        filed = materialize(filed, f"blocks{level}")
        large = materialize(filed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_block).select("block"), "large")
        if large.isEmpty():
            out.append(filed.select("block", "code"))
            return out
        out.append(filed.join(large, "block", "left_anti").select("block", "code"))
        current = filed.join(large, "block", "left_semi")
        open_bits = {f"{path}{i}": [b for b in left if b not in share] for path, left in open_bits.items() if path in shares for i, share in enumerate(shares[path])}
        level += 1


def near_links(codes: DataFrame, distance: int = DISTANCE, max_block: int = 4096) -> DataFrame:
    """Links (u, v) of distinct codes that connect all codes within the distance."""
    blocks = file_blocks(codes, list(range(64)), distance, max_block)
    found = None
    for part in blocks:
        links = (part.withColumn("rank", gray_rank(F.col("code")).bitwiseXOR(F.lit(-(2**63))))
                 .repartition("block").sortWithinPartitions("block", "rank").select("block", "code")
                 .mapInArrow(_block_links(distance, 1 << 16), "u long, v long"))
        found = links if found is None else found.unionByName(links)
    return found


def code_roots(codes: DataFrame, distance: int) -> DataFrame:
    """(code, ..., root): each distinct code with the least code of its component."""
    roots = materialize(components(near_links(codes.select("code"), distance)), "roots")
    return codes.join(roots, codes["code"] == roots["node"], "left").select(*codes.columns, F.coalesce("root", "code").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    codes = materialize(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    # the least doc_id of each component, then of each code
    tagged = materialize(code_roots(codes, distance), "tagged")
    named = materialize(tagged.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of_code = materialize(tagged.select("code", "root").join(named, "root").select("code", "component_id"), "of_code")
    return prints.join(of_code, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near duplicates, all columns as they were: that of the least id, rows without an id last.

    Rows are told apart by id and text together, so texts of different groups stay though they share an id. Of rows
    that are equal in both, one stays.
    """
    names = docs.columns
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]  # whatever the columns are called
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("did"), text_key(F.col(text_col)).alias("h"),
                      F.col(text_col).cast("binary").alias("body"))
    prints = materialize(own.mapInArrow(_keyed_prints(shingle), "id long, did long, h int, code long"), "prints")
    # what a code's rows choose first: a row with an id, the least, then by hash
    order = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "did", "h")).alias("row")
    codes = materialize(prints.groupBy("code").agg(order), "codes")
    chosen = code_roots(codes, distance).groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.did").alias("_did"), F.col("row.h").alias("_h"))
    chosen = materialize(chosen, "chosen")
    repeats = materialize(prints.groupBy(F.col("did").alias("_did"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeats")
    rows = docs.select(F.xxhash64(id_col, text_col).alias("_did"), text_key(F.col(text_col)).alias("_h"), *inner)
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    # the rows kept are as many as the documents, so the plan is a merge join at every size
    if repeats.isEmpty():
        return rows.join(chosen.hint("merge"), ["_did", "_h"], "left_semi").select(*out)
    alone = chosen.join(repeats, ["_did", "_h"], "left_anti")
    first = rows.join(chosen.join(repeats, ["_did", "_h"], "left_semi"), ["_did", "_h"], "left_semi").dropDuplicates(["_did", "_h"])
    return rows.join(alone.hint("merge"), ["_did", "_h"], "left_semi").unionByName(first).select(*out)
