"""Suffix-array dedup of repeated byte strings, exact, by a merge of front-coded runs.

Every `span`-byte window of a text has an anchor: the leftmost of its
`seed`-byte strings with the smallest hash. Equal windows have equal anchors at
equal places, so only suffixes that begin at an anchor (about one position in
eighteen) need sorting. The steps:

1. Texts are laid out in units of about a megabyte, written as a bucketed table.
2. Units send the sorted hashes of their anchors' seeds; what two documents
   share is told back to each unit as a bit mask.
3. Units send the suffixes at shared anchors, equal ones as one, as sorted runs
   with front coding: a suffix is the length of the prefix it has in common with
   the one before, and the rest. Runs meet by the hash of the seed.
4. A loser tree merges the runs. It keeps for each head the length of the prefix
   in common with the last winner, decides by these lengths alone where they
   differ, and compares bytes only beyond them. Suffixes with a common seed
   leave the tree together; for each window of theirs the smallest document is
   told back to the units.
5. Units mark the bytes of windows that a smaller document has, too.

A string that a third of all documents hold is one suffix per unit, and all
answers are per unit, so no step gathers the rows of one string.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.llm.common import BASE, BYTE_VALUES, mixed
from logrill.session import materialize

SLICE = 1 << 18  # positions handled at a time


class Unit:
    """The documents of one unit: ids, whether each is known (not null), sizes and bytes."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.ids, self.known, self.sizes, self.data = ids, known, sizes, data
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def anchors(self, span: int, seed: int):
        """(anchor, first window, last window, hash of the seed), in order of the windows' places."""
        found = []
        width = span - seed + 1  # seeds in a window
        usable = np.zeros(len(self.data) + 1, np.int32)
        long = self.known & (self.sizes >= span)
        np.add.at(usable, self.starts[long], 1)
        np.add.at(usable, self.ends[long] - span + 1, -1)
        usable = np.cumsum(usable[:-1]) > 0
        with np.errstate(over="ignore"):
            for low in range(0, max(len(self.data) - span + 1, 0), SLICE):
                part = BYTE_VALUES[self.data[low:low + SLICE + span - 1]]
                h, done = part, 1
                while done < seed:  # doubling: a polynomial in 2n bytes from two in n
                    n = min(done, seed - done)
                    h = h[:len(h) - n] * np.uint64(pow(BASE, n, 1 << 64)) + h[n:]
                    done += n
                h = mixed(h)
                key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
                best, done = key, 1
                while done < width:
                    n = min(done, width - done)
                    best = np.minimum(best[:len(best) - n], best[n:])
                    done += n
                at = (best & np.uint64((1 << 21) - 1)).astype(np.int64)
                p = np.flatnonzero(usable[low:low + len(at)])
                if not len(p):
                    continue
                a = at[p]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
                last = np.append(new[1:] - 1, len(p) - 1)
                found.append((a[new] + low, p[new] + low, p[last] + low, h[a[new]]))
        if not found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
        return tuple(np.concatenate(x) for x in zip(*found))

    def document_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, side="right")


def _seeds(unit: Unit, span: int, seed: int):
    """The anchors, the sorted distinct seeds as 48-bit numbers, which of these two documents of the unit share, and each anchor's."""
    a, lo, hi, h = unit.anchors(span, seed)
    keys, of = np.unique(h >> np.uint64(16), return_inverse=True)
    doc = unit.document_of(lo)
    first = np.full(len(keys), np.iinfo(np.int64).max)
    last = np.full(len(keys), -1)
    np.minimum.at(first, of, doc)
    np.maximum.at(last, of, doc)
    return (a, lo, hi, doc), keys, first != last, of


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 48-bit numbers, ascending with them."""
    return (keys >> np.uint64(16)).astype(np.int64) * buckets >> 32


def sorted_rows(words: np.ndarray) -> np.ndarray:
    """The stable order of rows of 64-bit words; only rows whose first two words are equal are sorted by the others, too."""
    if not len(words) or words.shape[1] < 3:
        return np.lexsort(words.T[::-1]) if len(words) else np.zeros(0, np.int64)
    order = np.lexsort((words[:, 1], words[:, 0]))
    first = words[order, :2]
    new = np.concatenate([[True], (first[1:] != first[:-1]).any(axis=1)])
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    some = order[tied]  # stays in its places, group by group
    order[tied] = some[np.lexsort((*words[some, 2:].T[::-1], np.cumsum(new)[tied]))]
    return order


class Variants:
    """The distinct suffixes at shared anchors: bytes from the anchor on, bytes before it, as far as windows reach."""

    def __init__(self, unit: Unit, anchors, shared: np.ndarray, of: np.ndarray, keys: np.ndarray, span: int, seed: int):
        some = shared[of]
        a, lo, hi, doc = (x[some] for x in anchors)
        before, after = a - lo, hi + span - a
        reach = span - seed
        rows = np.zeros((len(a), span + reach + 2), np.uint8)
        padded = np.concatenate([np.zeros(reach, np.uint8), unit.data, np.zeros(span, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, reach + span)  # at an anchor: `reach` bytes before, `span` from it on
        beyond, back = np.arange(span), np.arange(1, reach + 1)
        for k in range(0, len(a), 1 << 12):  # bounds the copies
            part = slice(k, k + (1 << 12))
            taken = around[a[part]]
            rows[part, :span] = np.where(beyond < after[part, None], taken[:, reach:], 0)
            rows[part, span + 1:-1] = np.where(back <= before[part, None], taken[:, :reach][:, ::-1], 0)
        rows[:, span], rows[:, -1] = after, before
        bucket_key = keys[of[some]]
        whole = np.ascontiguousarray(rows).view([("", f"V{rows.shape[1]}")]).ravel()
        # memory order of the bytes is their sorting order
        words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
        words[:, :rows.shape[1]] = rows
        order = sorted_rows(words.view(">u8").astype(np.uint64))
        ordered = whole[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(rows) else np.zeros(0, bool)
        self.rows = rows[order][new]
        self.key = bucket_key[order][new]
        number = np.cumsum(new) - 1
        self.of = np.empty(len(rows), np.int64)  # the variant of each occurrence
        self.of[order] = number
        self.anchor, self.document = a, doc
        ids = unit.ids[doc]
        self.least = np.full(len(self.rows), np.iinfo(np.int64).max)
        self.most = np.full(len(self.rows), np.iinfo(np.int64).min)
        np.minimum.at(self.least, self.of, ids)
        np.maximum.at(self.most, self.of, ids)
        self.reach, self.span = reach, span


def _codec() -> pa.Codec:
    """For the rest of suffixes: as small as zlib makes them in a quarter of the time."""
    return pa.Codec("zstd", compression_level=1)


def front_coded_parts(rows: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """(common prefix lengths, remaining bytes) of each part of rows of equal length, sorted part by part; a part begins at each cut."""
    if not len(rows):
        return
    width = rows.shape[1]
    differ = np.empty((len(rows), width + 1), bool)
    differ[:, width] = True
    differ[1:, :width] = rows[1:] != rows[:-1]
    differ[np.append(0, cuts)] = True
    common = differ.argmax(axis=1)
    rest = rows[np.arange(width) >= common[:, None]]
    ends = np.cumsum(width - common)[np.append(cuts, len(rows)) - 1]
    for n, low, high in zip(np.split(common.astype(np.uint8), cuts), [0, *ends.tolist()], ends.tolist()):
        yield n.tobytes(), rest[low:high].tobytes()


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """(common prefix lengths, remaining bytes) of sorted rows of equal length."""
    return next(front_coded_parts(rows, np.zeros(0, np.int64)), (b"", b""))


def front_decoded(common: bytes, rest: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(length of the prefix in common with the one before, row) for every row."""
    row, at = b"", 0
    for n in common:
        step = width - n
        row = row[:n] + rest[at:at + step]
        at += step
        yield n, row


class LoserTree:
    """Merges sorted runs of (common prefix length, row); where prefixes in common with the last winner differ, rows are not compared."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        n = self.size = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 1
        #: the row at the head of each run (None: used up), its bytes as a number, and how much of it is known to equal the last winner
        self.row: list[bytes | None] = [None] * n
        self.value: list[int | None] = [None] * n
        self.known = [0] * n
        for i, run in enumerate(runs):
            head = next(run, None)
            if head is not None:
                self.row[i], self.value[i] = head[1], int.from_bytes(head[1])
        self.loser = [0] * n
        winners = list(range(n))
        level = n
        while level > 1:
            half = []
            for k in range(0, level, 2):
                won, lost = self._play(winners[k], winners[k + 1])
                self.loser[(level + k) // 2] = lost
                half.append(won)
            winners, level = half, level // 2
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser keeps the prefix it has in common with the winner."""
        x, y = self.value[a], self.value[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        step = len(self.row[a]) - ((x ^ y).bit_length() + 7) // 8
        if x <= y:
            self.known[b] = step
            return a, b
        self.known[a] = step
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(prefix in common with the row before, run, row) in order."""
        row, value, known, loser, w = self.row, self.value, self.known, self.loser, self.winner
        while (last := row[w]) is not None:
            yield known[w], w, last
            width = len(last)
            head = next(self.runs[w], None)
            # the next row of the run is known to have this much in common with its last, which won
            k, row[w] = (0, None) if head is None else head
            x = value[w] = None if head is None else int.from_bytes(head[1])
            node = (w + self.size) >> 1
            while node:
                other = loser[node]
                y = value[other]
                if y is not None:
                    q = known[other]
                    # both are compared to the same last winner: the longer common prefix is the smaller row
                    if x is None or k < q:
                        known[w], loser[node] = k, w
                        w, k, x = other, q, y
                    elif k == q:
                        step = width - ((x ^ y).bit_length() + 7 >> 3)
                        if x <= y:
                            known[other] = step
                        else:
                            known[w], loser[node] = step, w
                            w, x = other, y
                node >>= 1
            known[w] = k


FEW = 40  # suffixes of one seed that are compared pair by pair


def _least_by_pairs(rows: dict[bytes, int], span: int, reach: int) -> dict[bytes, list[tuple[int, int, int]]]:
    """For each suffix, stretches of offsets and the smallest document of the windows there.

    Two suffixes have the window at offset i in common if they agree on i bytes
    before the anchor and span - i from it on; both lengths are read off the
    highest differing bit.
    """
    known = []
    for row, least in rows.items():
        known.append((row, least, span - row[span], row[span + 1 + reach], int.from_bytes(row[:span]),
                      int.from_bytes(row[span + 1:span + 1 + reach])))
    told = {}
    for row, least, low, high, right, left in known:
        cuts = []
        for other, d, low_, high_, right_, left_ in known:
            if d < least:
                i = max(low, low_, span - (8 * span - (right ^ right_).bit_length()) // 8)
                j = min(high, high_, (8 * reach - (left ^ left_).bit_length()) // 8)
                if i <= j:
                    cuts.append((i, j, d))
        if not cuts:
            told[row] = [(low, high, least)]
            continue
        best = [least] * (high + 1)
        for i, j, d in cuts:
            for k in range(i, j + 1):
                if d < best[k]:
                    best[k] = d
        told[row] = _stretches(best, low, high)
    return told


def _least_by_windows(rows: dict[bytes, int], span: int, reach: int) -> dict[bytes, list[tuple[int, int, int]]]:
    """The same through a table of all windows, for many suffixes."""
    best: dict[tuple[int, bytes], int] = {}
    windows = {}
    for row, least in rows.items():
        left = row[span + 1:span + 1 + reach]
        own = windows[row] = [(i, left[:i] + row[:span - i]) for i in range(span - row[span], row[span + 1 + reach] + 1)]
        for key in own:
            if best.get(key, least) >= least:
                best[key] = least
    return {row: _stretches([0] * own[0][0] + [best[key] for key in own], own[0][0], own[-1][0]) for row, own in windows.items()}


def _stretches(best: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    spans = [(low, low, best[low])]
    for i in range(low + 1, high + 1):
        if best[i] == spans[-1][2]:
            spans[-1] = (spans[-1][0], i, best[i])
        else:
            spans.append((i, i, best[i]))
    return spans


def _answers(group: list[tuple[bytes, int, int, int, int]], span: int, reach: int):
    """(run, number, from, to, smallest document) for the suffixes of one seed, given (row, run, number, least, most).

    A window that begins i bytes before the anchor is the i bytes before it and
    the span - i from it on. Told are only stretches of i where some document
    of the suffix is not the smallest.
    """
    rows: dict[bytes, int] = {}
    for row, _, _, least, _ in group:
        rows[row] = min(rows.get(row, least), least)
    if len(rows) == 1:
        (row, least), = rows.items()
        low, high = span - row[span], row[span + 1 + reach]
        for _, run, number, _, most in group:
            if least < most:
                yield run, number, low, high, least
        return
    told = (_least_by_pairs if len(rows) <= FEW else _least_by_windows)(rows, span, reach)
    for row, run, number, _, most in group:
        for low, high, d in told[row]:
            if d < most:
                yield run, number, low, high, d


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 50, seed: int = 16,
             unit_bytes: int = 1 << 20) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row.

    Removed is each byte of a text (UTF-8) that a `span`-byte string covers
    which also starts in a document with a smaller key. A null or empty text has
    no byte; texts shorter than `span` lose nothing. Rows of a repeated key do
    not remove from each other. A row with a null key loses nothing and removes
    nothing. `span` is at most 128.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    total = rows.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    units = max(1, -(-total // unit_bytes))
    buckets = max(4, total // (8 << 20))  # of seeds and of suffixes; about half a million anchors to a bucket

    def lay_out(part: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, sizes, packed, size = [], [], [], [], 0
        squeeze = zlib.compressobj(1)

        def flush():
            nonlocal ids, known, sizes, packed, size, squeeze
            row = pa.RecordBatch.from_arrays(
                [pa.array([part[0].as_py()], pa.int64()),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(known, bool).tobytes()], pa.binary()),
                 pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join([*packed, squeeze.flush()])], pa.binary())], names=["unit", "ids", "known", "sizes", "packed"])
            ids, known, sizes, packed, size = [], [], [], [], 0
            squeeze = zlib.compressobj(1)
            return row

        for batch in batches:
            for i, value in zip(batch.column("id").to_pylist(), batch.column("bytes")):
                value = value.as_py()
                ids.append(i or 0)
                known.append(i is not None)
                sizes.append(len(value))
                packed.append(squeeze.compress(value))
                size += len(value)
                if size > 4 * unit_bytes:  # only where hashing dealt unevenly or a text is long: a second row of the unit
                    yield flush()
        if ids:
            yield flush()

    dealt = rows.withColumn("unit", F.pmod(F.xxhash64("id", F.md5("bytes")), F.lit(units)))
    laid = dealt.groupBy("unit").applyInArrow(lay_out, "unit long, ids binary, known binary, sizes binary, packed binary")
    # a row of the table is from here on the unit that answers are addressed to
    laid = laid.withColumn("unit", F.xxhash64("unit", "ids", "sizes", F.md5("packed")))
    name = f"suffix_units_{uuid.uuid4().hex}"
    files = max(1, min(-(-units // 4), 4096))  # a task has a few units, one after another
    laid.repartition(files, "unit").write.bucketBy(files, "unit").format("parquet").option("compression", "none").saveAsTable(name)
    table = spark.table(name)

    def unit_of(batch, i) -> Unit:
        pa.set_memory_pool(pa.system_memory_pool())  # a worker gives back what a unit took
        ids, known, sizes, packed = (batch.column(c)[i].as_py() for c in ("ids", "known", "sizes", "packed"))
        return Unit(np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(sizes, np.int64),
                    np.frombuffer(zlib.decompress(packed), np.uint8))

    def send_seeds(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, keys, within, _ = _seeds(unit_of(batch, i), span, seed)
                if not len(keys):
                    continue
                bucket = _bucket(keys, buckets)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                parts = np.split(keys, cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[np.append(0, cuts)], pa.int64()), pa.array([batch.column("unit")[i].as_py()] * len(parts), pa.int64()),
                     pa.array([(k >> np.uint64(16)).astype(np.uint32).tobytes() for k in parts], pa.binary()),
                     pa.array([(k & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for k in parts], pa.binary()),
                     pa.array([np.packbits(w).tobytes() for w in np.split(within, cuts)], pa.binary())],
                    names=["bucket", "unit", "high", "low", "within"])

    def share_seeds(bucket: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, within = [], [], []
        for batch in batches:
            names += batch.column("unit").to_pylist()
            for high, low, bits in zip(*(batch.column(c).to_pylist() for c in ("high", "low", "within"))):
                k = np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(low, np.uint16)
                keys.append(k)
                within.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(k)).astype(bool))
        sizes = [len(k) for k in keys]
        _, of, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[of[np.concatenate(within)]] = True
        masks = np.split(shared[of], np.cumsum(sizes)[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([bucket[0].as_py()] * len(names), pa.int64()), pa.array(sizes, pa.int64()),
             pa.array([np.packbits(mask).tobytes() for mask in masks], pa.binary())], names=["unit", "bucket", "n", "mask"])

    seeds = table.mapInArrow(send_seeds, "bucket long, unit long, high binary, low binary, within binary")
    # a bucket is little to read and much to do: each has a task, whatever its bytes
    masks = seeds.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(share_seeds, "unit long, bucket long, n long, mask binary")
    per_unit = masks.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "mask"))).alias("masks"))
    per_unit = materialize(per_unit, "suffix_masks")  # a bit for each seed of a unit

    def variants_of(batch, i) -> tuple[Unit, Variants]:
        unit = unit_of(batch, i)
        anchors, keys, _, of = _seeds(unit, span, seed)
        masks = batch.column("masks")[i].as_py() or []  # none where no text is long enough
        bits = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]) for m in masks]
        shared = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        return unit, Variants(unit, anchors, shared, of, keys, span, seed)

    def send_runs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, v = variants_of(batch, i)
                bucket = _bucket(v.key, buckets)
                order = np.argsort(bucket, kind="stable")  # suffixes stay sorted in their bucket
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                parts, coded = np.split(order, cuts), list(front_coded_parts(v.rows[order], cuts))
                if not coded:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order[np.append(0, cuts)]], pa.int64()), pa.array([batch.column("unit")[i].as_py()] * len(parts), pa.int64()),
                     pa.array([common for common, _ in coded], pa.binary()),
                     pa.array([_codec().compress(rest, asbytes=True) for _, rest in coded], pa.binary()),
                     pa.array([some.astype(np.int32).tobytes() for some in parts], pa.binary()),
                     pa.array([zlib.compress(v.least[some].tobytes(), 1) for some in parts], pa.binary()),
                     pa.array([zlib.compress((v.most[some] - v.least[some]).tobytes(), 1) for some in parts], pa.binary())],
                    names=["bucket", "unit", "common", "rest", "number", "least", "most"])

    reach = span - seed
    width = span + reach + 2

    def merge(bucket: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        names, runs, number, least, more = [], [], [], [], []
        for batch in batches:
            names += batch.column("unit").to_pylist()
            for common, rest in zip(batch.column("common").to_pylist(), batch.column("rest").to_pylist()):
                size = width * len(common) - sum(common)
                runs.append(front_decoded(common, _codec().decompress(rest, size, asbytes=True), width))
            number += [memoryview(x).cast("i") for x in batch.column("number").to_pylist()]
            least += [memoryview(zlib.decompress(x)).cast("q") for x in batch.column("least").to_pylist()]
            more += [memoryview(zlib.decompress(x)).cast("q") for x in batch.column("most").to_pylist()]
        at = [0] * len(runs)
        told: dict[int, array] = {}  # numbers, four of them an answer
        group: list = []

        def close():
            for run, *answer in _answers(group, span, reach):
                if run not in told:
                    told[run] = array("q")
                told[run].extend(answer)

        for common, run, row in LoserTree(runs):
            if common < seed and group:
                close()
                group = []
            k = at[run]
            at[run] = k + 1
            first = least[run][k]
            group.append((row, run, number[run][k], first, first + more[run][k]))
        if group:
            close()
        for run, answers_ in told.items():
            n, low, high, d = np.frombuffer(answers_, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[run]], pa.int64()), pa.array([n.astype(np.int32).tobytes()], pa.binary()),
                 pa.array([low.astype(np.uint8).tobytes()], pa.binary()), pa.array([high.astype(np.uint8).tobytes()], pa.binary()),
                 pa.array([d.tobytes()], pa.binary())], names=["unit", "number", "low", "high", "first"])

    with_masks = table.join(per_unit.hint("shuffle_hash"), "unit")
    runs = with_masks.mapInArrow(
        send_runs, "bucket long, unit long, common binary, rest binary, number binary, least binary, most binary")
    answers = runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, "unit long, number binary, low binary, high binary, first binary")
    answers = answers.groupBy("unit").agg(F.collect_list(F.struct("number", "low", "high", "first")).alias("answers"))
    answers = materialize(answers, "suffix_answers")

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                unit, v = variants_of(batch, i)
                cover = np.zeros(len(unit.data) + 1, np.int32)
                given = batch.column("answers")[i]
                if given.is_valid:
                    order = np.argsort(v.of, kind="stable")
                    first_of = np.searchsorted(v.of[order], np.arange(len(v.rows) + 1))
                    for answer in given:
                        number = np.frombuffer(answer["number"].as_py(), np.int32)
                        low, high = (np.frombuffer(answer[c].as_py(), np.uint8).astype(np.int64) for c in ("low", "high"))
                        first = np.frombuffer(answer["first"].as_py(), np.int64)
                        times = first_of[number + 1] - first_of[number]
                        each = np.repeat(np.arange(len(number)), times)
                        place = order[np.repeat(first_of[number] - (np.cumsum(times) - times), times) + np.arange(len(each))]
                        later = unit.ids[v.document[place]] > first[each]
                        each, place = each[later], place[later]
                        np.add.at(cover, v.anchor[place] - high[each], 1)
                        np.add.at(cover, v.anchor[place] - low[each] + span, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed, spans, digests = [], [], []
                for a, b in zip(unit.starts.tolist(), unit.ends.tolist()):
                    g = gone[a:b]
                    n = int(g.sum())
                    removed.append(n)
                    spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
                    digests.append(hashlib.sha256((unit.data[a:b][~g] if n else unit.data[a:b]).tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit.ids, mask=~unit.known), pa.array(unit.sizes), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                    names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both = table.join(per_unit.hint("shuffle_hash"), "unit", "left").join(answers.hint("shuffle_hash"), "unit", "left")
    result = materialize(both.mapInArrow(
        cut, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "suffix_result")
    spark.sql(f"DROP TABLE {name}")
    return result
