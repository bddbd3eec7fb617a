"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put into size bands so that linked sets lie in one
band or in neighbours. In a band, linked sets differ in at most k elements. The
domain is hashed into k + 1 + s partitions; two linked sets then agree on at
least s + 1 of them, and the elements of one partition are a signature. The
slack s exists so that nearly empty partitions, which unrelated sets share by
chance, need no signature: a set leaves out s of them, the emptiest first, and
agrees with each partner on at least one other partition. A set with more of them
sends the rest, so no link is lost at any size.

Elements that very many sets hold (common lines and passages) take no part in
signatures: leaving the same elements out of all sets never makes two sets
differ in more, so which ones are left out decides about speed only, and they
may be found on a sample.

Signatures travel as packed arrays, one row per batch of documents and slice of
the signature space, after equal ones of a batch have been reduced to one. In a
slice 48 bits tell them apart; a chance pair is one more candidate to verify.
Where only two sets share a signature, they are compared by sketches first: a bit
per cell of the hashed domain, whether the set has an odd number of elements
there. Each differing bit stands for at least one element of A ∆ B, so a pair
whose sketches differ in more bits than A ∆ B may have is surely not linked, and
most chance pairs, which share a passage, go here. This keeps families, the
connected components of what is left, from growing together through chains of
shared passages. A family of more than one block signs again, by other partitions
and among its own sets only, and falls apart into the families of that graph; as
linked sets share a signature whatever the partitions, no link is lost. Families
that stay large are cut into blocks, and each pair of blocks is
verified in one task by counting common elements exactly. A task sends a spanning
forest of the links it finds, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.llm.byte_bpe import groups
from logrill.llm.common import components, forest, mixed, stretches
from logrill.session import bounded_batches, discard, materialize

#: The bytes that separate words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
SIGNATURES = 1 << 21  # signatures that a task reduces at a time
PARTS = 16  # in which these are sorted
KEPT_BITS = 48  # of a signature within its slice of about 2 million: hardly one in a hundred slices has a chance pair
SILENT = 1 << 20  # copies that are named to all tasks so that they do not sign; the others sign, which costs time only
PAIRED = 12  # differences up to which signatures are of two partitions
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = FOLDED[np.frombuffer(b" ".join([*parts, b""]), np.uint8)]
    ends_of_text = np.cumsum([len(p) + 1 for p in parts])
    inside = ~SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    word = stretches(data, starts, ends)
    text_of = np.searchsorted(ends_of_text, starts, side="right")
    counts = np.bincount(text_of, minlength=len(parts))
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            w = word[at:at + n]
            at += n
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            width = min(words, n)
            h = np.full(n - width + 1, width, np.uint64)
            for i in range(width):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i:n - width + 1 + i])
            out.append(np.unique(h))
    return out


class Bands:
    """Size bands for links of Jaccard similarity >= num / den, by integers."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        lows, low = [], 1
        while low <= largest:
            lows.append(low)
            low = low * den // num + 1
        self.lows = np.array([*lows, low, low * den // num + 1, (low * den // num + 1) * den // num + 1], np.int64)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def differences(self, band: int) -> int:
        """Linked sets of this band, or of it and the one before, differ in at most so many elements.

        |A ∆ B| <= (den - num) / (den + num) * (|A| + |B|), and neither is larger than the band's end.
        """
        return int(2 * (self.lows[band + 1] - 1) * (self.den - self.num) // (self.den + self.num))

    def partitions(self, band: int) -> tuple[int, int, int, bool]:
        """Partitions, slack s, how few elements count as nearly empty, and whether signatures are of pairs of partitions.

        All follow from the band alone, so they are equal for all its sets. Small
        sets, whose partitions would hold hardly an element each, have k + 2
        partitions and a signature for every two of them: linked sets agree on two.
        For others the slack is the smallest that covers nearly all sets of the
        band's smallest size.
        """
        k, size = self.differences(band), float(self.lows[max(band - 1, 0)])
        if k <= PAIRED:
            return k + 2, 0, 0, True
        for few in (2, 1):
            slack = 0
            while slack <= k + 1:
                n = k + 1 + slack
                mean = size / n
                expected = n * np.exp(-mean) * (1 + mean * (few == 2))
                if slack >= expected + 3 * np.sqrt(expected) - 0.3:
                    return n, slack, few, False
                slack = max(slack + 1, int(slack * 1.05))
        return k + 1, 0, 0, False


def common_elements(docs: DataFrame, words: int, rows: int, sample: int = 5000, least: int = 10) -> np.ndarray:
    """Sorted elements that at least `least` of about `sample` sets of (id, text) hold; at most sample / least * mean size."""

    def run(batches):
        for batch in batches:
            for some in groups([t or "" for t in batch.column(1).to_pylist()]):
                keys, n = np.unique(np.concatenate(shingle_sets(some, words)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["element", "n"])

    picked = docs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // sample))) == 0)
    counted = picked.mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= least).select("element").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _stretches_of(batches):
    """Ids, texts and families (0 where there are none) of (id, text[, family]) batches, a few texts at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            ids, at = part.column(0).to_pylist(), 0
            family = part.column(2).to_pylist() if part.num_columns > 2 else [0] * part.num_rows
            for some in groups([t or "" for t in part.column(1).to_pylist()]):
                yield ids[at:at + len(some)], some, family[at:at + len(some)]
                at += len(some)


def signatures(elements: np.ndarray, bands: Bands, plans: dict, common: np.ndarray, seed: int = 0, family: int = 0) -> np.ndarray:
    """The set's signatures: 64-bit hashes of (family, band, partition or two, elements there that are not common).

    The seed chooses the partitions.
    """
    own = bands.band(len(elements))
    found = []
    if len(common):
        elements = elements[common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] != elements]
    with np.errstate(over="ignore"):
        salt, apart = mixed(np.array([seed, family & ((1 << 64) - 1)], np.uint64))
        scrambled = mixed(elements ^ np.uint64(0xD6E8FEB86659FD93) ^ salt)
        for band in (own, own + 1):
            if band not in plans:
                plans[band] = bands.partitions(band)
            n, slack, least, paired = plans[band]
            part = ((scrambled >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            counts = np.bincount(part, minlength=n)
            order = np.argsort(part, kind="stable")
            filled = np.flatnonzero(counts)
            sums = np.zeros(n, np.uint64)
            if len(filled):
                sums[filled] = np.add.reduceat(scrambled[order], np.concatenate([[0], np.cumsum(counts[filled])[:-1]]))
            few = np.flatnonzero(counts < least)
            # empty ones first, then by place: what two sets agree on stands in one order in both, so they leave out at most `slack` of it
            keep = np.delete(np.arange(n), few[np.argsort(counts[few], kind="stable")[:slack]])
            tag = keep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1) + apart
            single = mixed(sums[keep] + mixed(tag))
            if paired:
                one, two = np.triu_indices(n, 1)
                single = mixed(single[one] * np.uint64(3) + single[two])
            found.append(single)
    return np.concatenate(found)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.astype("<i8", copy=False).tobytes() for c in columns)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    whole = np.frombuffer(blob, np.int64)
    return list(whole.reshape(columns, -1))


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of 64-bit values, a plane per byte, so that what sorted values have in common compresses."""
    return values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(blob: memoryview, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def sketch(elements: np.ndarray) -> bytes:
    """A bit for each of n to 2n cells: whether an odd number of the n elements falls there."""
    cells = 64
    while cells < len(elements):
        cells *= 2
    scrambled = mixed(elements ^ np.uint64(0xA0761D6478BD642F))
    counts = np.bincount((scrambled & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(one: bytes, two: bytes) -> int:
    """A lower bound of the number of elements that only one of two sets has, from their sketches."""
    a, b = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    while len(b) > len(a):  # the cells are the lowest bits of a hash
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _pack_signatures(sig: np.ndarray, ids: np.ndarray, many: np.ndarray) -> bytes:
    """Signatures below 2**KEPT_BITS, ids as their distance from the smallest in as few bytes as all need, and a bit."""
    base = ids.min()
    with np.errstate(over="ignore"):
        apart = ids.view(np.uint64) - base.astype(np.uint64)
    width = max(1, -(-int(apart.max()).bit_length() // 8))
    return (np.array([base, width, len(sig)], "<i8").tobytes() + _planes(sig, KEPT_BITS // 8) + _planes(apart, width)
            + np.packbits(many).tobytes())


def _unpack_signatures(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, width, n = np.frombuffer(blob[:24], "<i8")
    n, of_sig = int(n), int(n) * (KEPT_BITS // 8)
    of_ids = of_sig + n * int(width)
    body = memoryview(blob)[24:]
    with np.errstate(over="ignore"):
        ids = _from_planes(body[of_sig:of_ids], int(width)) + base.astype(np.uint64)
    many = np.unpackbits(np.frombuffer(body[of_ids:], np.uint8), count=n).astype(bool)
    return _from_planes(body[:of_sig], KEPT_BITS // 8).view(np.int64), ids.view(np.int64), many


def _reduced(sig: np.ndarray, ids: np.ndarray, many: np.ndarray):
    """Signatures in order with their ids; of those that three or more ids share only the smallest, marked `many`.

    Then edges from the smallest id to the others of these, and the pairs that alone share a signature.
    """
    none = np.zeros((0, 2), np.int64)
    if not len(sig):
        return sig, ids, many, none, none
    order = np.lexsort((ids, sig))
    sig, ids, many = sig[order], ids[order], many[order]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    many = np.logical_or.reduceat(many, starts)
    own = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
    sig, ids = sig[own], ids[own]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    starts, bucket = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(starts, len(sig)))
    many |= size > 2
    leader = ids[starts]
    other = ~new & many[bucket]
    edges = np.unique(np.stack([leader[bucket[other]], ids[other]], axis=1), axis=0) if other.any() else none
    two = ~new & ~many[bucket]
    pairs = np.unique(np.stack([leader[bucket[two]], ids[two]], axis=1), axis=0) if two.any() else none
    return sig[~other], ids[~other], many[bucket[~other]], edges, pairs


def _families(docs: DataFrame, words: int, num: int, den: int, largest: int, slices: int, common: np.ndarray,
              seed: int = 0, copies: np.ndarray | None = None) -> DataFrame:
    """Edges (a, b, many) between documents that share a signature; those with an id of `copies` (sorted) do not sign.

    Signatures of three or more are stars, with `many` true, those of a slice joined into trees; one of two is their pair.
    With a seed above 0 docs is (id, text, family), and only members of one family share signatures.
    """

    shared = docs.sparkSession.sparkContext.broadcast((common, np.zeros(0, np.int64) if copies is None else copies))

    def sign(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # a worker gives back what a batch took
        bands, plans, (common, copies), signed = Bands(num, den, largest), {}, shared.value, set()
        sigs, of, held = [], [], 0

        def sent():
            nonlocal sigs, of, held
            sig, own = np.concatenate(sigs).view(np.int64), np.concatenate(of)
            sigs, of, held = [], [], 0
            span = -(-(1 << 63) // slices) * 2
            place = (np.floor_divide(sig, span) + slices // 2 + 1).astype(np.int32)
            step = -(-slices // PARTS)
            for low in range(0, slices + 2, step):  # a few slices at a time bound the copies that sorting makes
                part = (place >= low) & (place < low + step)
                yield from packed(sig[part], own[part], span)

        def packed(sig, own, span):
            sig, own, many, local, _ = _reduced(sig, own, np.zeros(len(sig), bool))
            slice_ = np.floor_divide(sig, span) + slices // 2 + 1  # sig is sorted
            rest = np.mod(sig, span) >> max(0, (span - 1).bit_length() - KEPT_BITS)
            cuts = np.flatnonzero(np.diff(slice_)) + 1
            for s, o, m, p in zip(*(np.split(x, cuts) for x in (rest, own, many, slice_))) if len(sig) else ():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(p[0])]), pa.array([_pack_signatures(s, o, m)], pa.binary()), pa.array([b""], pa.binary())],
                    names=["slice", "signatures", "edges"])
            if len(local):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(local[:, 1].sum() >> 1)]), pa.array([b""], pa.binary()), pa.array([_pack(local[:, 0], local[:, 1])], pa.binary())],
                    names=["slice", "signatures", "edges"])

        for ids, some, family in _stretches_of(batches):
            signs = np.flatnonzero(~np.isin(ids, copies)) if len(copies) else range(len(ids))
            ids, some, family = ([x[i] for i in signs] for x in (ids, some, family))
            for i, elements, f in zip(ids, shingle_sets(some, words), family):
                key = (hashlib.blake2b(elements.tobytes(), digest_size=16).digest(), i if seed else None)
                if len(elements) and key not in signed:  # of copies in a task one signs
                    signed.add(key)
                    found = signatures(elements, bands, plans, common, seed, f)
                    sigs.append(found)
                    of.append(np.full(len(found), i, np.int64))
                    held += len(found)
            if held >= SIGNATURES:  # the more at a time, the more equal ones are reduced to one
                yield from sent()
        if held:
            yield from sent()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        waiting, size = [], 0
        edges, pairs = [], np.zeros((0, 2), np.int64)

        def fold():
            nonlocal held, waiting, size, pairs
            parts = [held, *(_unpack_signatures(b) for b in waiting)]
            *held, new, pairs = _reduced(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
            edges.append(new)
            waiting, size = [], 0
        for batch in batches:
            for blob, local in zip(batch.column("signatures"), batch.column("edges")):
                if len(local.as_py()):
                    edges.append(np.stack(_unpack(local.as_py(), 2), axis=1))
                if blob := blob.as_py():
                    waiting.append(blob)
                    size += len(blob)
                if size > 1 << 24:
                    fold()
        if waiting:
            fold()
        found = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        if len(found):  # stars that overlap become trees, so a slice tells of a document once; pairs within a tree say nothing new
            nodes, least = forest(found[:, 0], found[:, 1])
            at = np.minimum(np.searchsorted(nodes, pairs), len(nodes) - 1)
            pairs = pairs[(nodes[at] != pairs).any(axis=1) | (least[at[:, 0]] != least[at[:, 1]])]
            found = np.stack([least, nodes], axis=1)[nodes != least]
        for some, many in ((found, True), (pairs, False)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(np.full(len(some), many))], names=["a", "b", "many"])

    signed = docs.mapInArrow(sign, "slice long, signatures binary, edges binary")
    return signed.groupBy("slice").applyInArrow(meet, "a long, b long, many boolean").distinct()


def _ids(df: DataFrame) -> np.ndarray:
    """The sorted ids of (id, ...)."""
    return np.sort(df.select("id").toArrow().column(0).to_numpy().astype(np.int64))


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out; sets: (id, n, sketch), a few rows per id."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, one, two in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))):
                # den * |A ∩ B| >= num * |A ∪ B| where |A ∆ B| * (den + num) <= (den - num) * (|A| + |B|)
                keep.append((den + num) * differing(one, two) <= (den - num) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        named = sets.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        pairs = pairs.join(named.hint("merge"), end)
        if end == "b":
            pairs = pairs.where(F.greatest("n_a", "n_b") * num <= F.least("n_a", "n_b") * den)
    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long").distinct()


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among n sets."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return kept


def linked(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * |A ∩ B| >= num * |A ∪ B|, by exact counts."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if den * common >= num * (sizes.sum() - common) else []
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[of]
    rows, of = rows[keep], number[of[keep]]
    order = np.argsort(of, kind="stable")
    rows, of = rows[order], of[order]
    common = np.zeros((n, n), np.float32)
    step = max(1, (1 << 22) // n)
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(of, [low, low + step])
        dense = np.zeros((n, min(step, int(shared.sum()) - low)), np.float32)
        dense[rows[a:b], of[a:b] - low] = 1
        common += dense @ dense.T  # whole numbers below 2**24 stay exact in float32
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    a, b = np.nonzero(np.triu(den * common >= num * union, 1))
    return _forest(a, b, n)


def _sized(members: DataFrame, block_elements: int, block_sets: int) -> DataFrame:
    """(family, size, total, blocks) of families with two members or more."""
    sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    return sizes.withColumn("blocks", F.greatest(
        F.ceil(F.col("total") / block_elements), F.ceil(F.col("size") / block_sets)).cast("long"))


def _verified(members: DataFrame, docs: DataFrame, words: int, num: int, den: int,
              block_elements: int, block_sets: int) -> DataFrame:
    """Links (a, b), enough to connect what is linked. members: id, family, n, a row per distinct set; docs: id, text."""

    def shingle(batches):
        for batch in batches:
            at = 0
            for some in groups([t or "" for t in batch.column("text").to_pylist()]):
                sets = shingle_sets(some, words)
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("family"), part.column("blocks"), part.column("block"),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "family", "blocks", "block", "elements"])

    sizes = _sized(members, block_elements, block_sets)
    # the members grow with the documents, so this is a sort-merge join at every size
    placed = (members.join(sizes, "family").join(docs.hint("merge"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
              .select("id", "family", "blocks", "block", "text")
              .mapInArrow(shingle, "id long, family long, blocks long, block long, elements binary"))
    # a family of one block shares a task with other small ones; a larger one has a task for each pair of its blocks
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    spread = placed.select("id", "family", "elements", "blocks", "block", other)
    count = sizes.agg(F.sum("total")).first()[0] or 0
    bundles = max(1, -(-count // block_elements))
    key = F.when(F.col("blocks") == 1, F.struct(
        F.lit(-1).cast("long").alias("f"), F.pmod(F.xxhash64("family"), F.lit(bundles)).alias("i"), F.lit(0).cast("long").alias("j")))
    key = key.otherwise(F.struct(F.col("family").alias("f"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

    def verify(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, family, blob in zip(batch.column("id").to_pylist(), batch.column("family").to_pylist(), batch.column("elements")):
                held.setdefault(family, []).append((i, np.frombuffer(blob.as_buffer(), np.uint64)))
        a, b = [], []
        for some in held.values():
            if len(some) > 1:
                for x, y in linked([s for _, s in some], num, den):
                    a.append(some[x][0])
                    b.append(some[y][0])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (spread.select(key.alias("key"), "id", "family", "elements").groupBy("key")
            .applyInArrow(verify, "a long, b long"))


def set_digests(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, digest, sketch): size, 128-bit digest and sketch of each text's shingle set; docs is (id, text)."""

    def run(batches):
        for ids, some, _ in _stretches_of(batches):
            sets = shingle_sets(some, words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([sketch(s) for s in sets], pa.binary())],
                names=["id", "n", "digest", "sketch"])

    return docs.mapInArrow(run, "id long, n long, digest binary, sketch binary")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3,
                       num: int = 90, den: int = 100, block_elements: int = 1 << 19, block_sets: int = 1024) -> DataFrame:
    """(key, n_shingles, component_id) per row: components of the links den * |A ∩ B| >= num * |A ∪ B|.

    Sets are distinct shingles of `words` words (ASCII lower case, separated by
    ASCII white space); a shorter text is one shingle. Texts that are null or
    without a word have no shingle and link with nothing. component_id is the
    smallest key of the component. A null key gives its row with a null
    component; rows of a repeated key link as their texts do, and the key stands
    for all of them. The key must be an integer. Shingles are told apart by
    64-bit hashes. An empty table gives no row.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    keyed = rows.where("id IS NOT NULL")
    marks = materialize(set_digests(rows, words), "jaccard_sets")
    largest, total, count = marks.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    largest, total = largest or 1, total or 0

    def slices_of(elements):  # about 3 * (1 - similarity) signatures a shingle; 2 million to a slice
        return max(4, int(elements * 3 * (den - num) / den) >> 21)

    # of copies one stands for all, from the signatures to the components; the others join them by the digest
    sets = marks.where("digest IS NOT NULL AND id IS NOT NULL")
    stands = sets.groupBy("digest").agg(F.min("id").alias("stand"), F.max("id").alias("last"), F.first("n").alias("n"))
    several = sets.groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("two")).where("one <> two").select("id")
    apart = sets.join(stands.where("stand <> last").select("digest", "stand"), "digest").where("id <> stand").select("id", "stand")
    copied = materialize(apart.join(several, "id", "left_anti").distinct(), "jaccard_copies")
    # a key with different sets links the copies of all of them, and signs for each
    both = sets.join(several, "id", "left_semi").join(stands.select("digest", "stand"), "digest").select("id", "stand")
    between = both.where("id <> stand").select(F.col("stand").alias("a"), F.col("id").alias("b"))
    signers = copied.union(both)
    common, silent = common_elements(keyed, words, count), _ids(copied.limit(SILENT))
    shared = materialize(_families(keyed, words, num, den, largest, slices_of(total), common, copies=silent), "jaccard_candidates")
    for end in ("b", "a"):
        named = signers.select(F.col("id").alias(end), F.col("stand").alias("_stand"))
        shared = (shared.join(named, end, "left").withColumn(end, F.coalesce("_stand", end)).drop("_stand")
                  .where("a <> b").distinct())
    signing = sets.select("id", "n", "sketch").distinct()
    shared = materialize(shared.where("many").select("a", "b").union(
        _possible(shared.where("not many").select("a", "b"), signing, num, den)).distinct(), "jaccard_possible")
    family = components(shared, "jaccard_family")
    members = stands.select(F.col("stand").alias("id"), "n").join(family, "id").select("id", F.col("component").alias("family"), "n")
    members = materialize(members, "jaccard_members")
    # the texts of members move once; the steps below read these only
    held = materialize(members.select("id").distinct().join(keyed.hint("merge"), "id").select("id", "text"), "jaccard_texts")
    # families of several blocks fall apart by other partitions, as long as that makes their block pairs fewer
    before, seed = None, 0
    while True:
        large = _sized(members, block_elements, block_sets).where("blocks > 1")
        elements, pairs = large.agg(F.sum("total"), F.sum(F.col("total") * F.col("blocks"))).first()
        if not pairs or (before and pairs > 0.8 * before):
            break
        before, seed = pairs, seed + 1
        inside = members.join(large.select("family"), "family", "left_semi")
        texts = inside.select("id", "family").distinct().join(held.hint("merge"), "id").select("id", "text", "family")
        again = materialize(_families(texts, words, num, den, largest, slices_of(elements), common, seed), "jaccard_again")
        again = again.where("many").select("a", "b").union(
            _possible(again.where("not many").select("a", "b"), signing, num, den)).distinct()
        family = components(again, "jaccard_family").select("id", F.col("component").alias("family"))
        members = materialize(
            members.join(large.select("family"), "family", "left_anti").select("id", "family", "n")
            .union(inside.select("id", "n").join(family, "id").select("id", "family", "n")), "jaccard_members")
    links = _verified(members, held, words, num, den, block_elements, block_sets)
    found = components(materialize(links.union(between), "jaccard_links"), "jaccard_component")
    found = materialize(copied.join(found.withColumnRenamed("id", "stand"), "stand", "left").select(
        "id", F.coalesce("component", "stand").alias("component")).union(found), "jaccard_found")
    discard(held)
    return (marks.join(found, "id", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))
