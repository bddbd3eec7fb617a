"""Byte-level BPE encoding and decoding with segment trees over byte positions.

A rank file names byte strings by id; smaller ids merge first. A piece of text
is encoded by merging, again and again, the leftmost adjacent pair of smallest
rank. A segment tree over the byte positions of the piece holds at its root the
smallest (rank, position) of all live pairs, so each merge is one look at the
root and a logarithmic number of point updates for the pair itself, its right
part and its live left neighbour.

The trees of many distinct pieces of one size class are held side by side in
numpy arrays and advance together, one merge of every unfinished piece per
step. Distinct stretches between single spaces are encoded once per task and
remembered in a table that is emptied when it is full; results do not depend
on its size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from logrill.session import bounded_batches

#: A cut before a single space between two other characters is a cut of the split pattern, too.
CUT = regex.compile(r"(?<=\S) (?=\S)")
ODD_SPACES = re.compile(r"\s\s|^\s|\s\Z")
#: A word of Latin letters, and marks after it: two pieces of the split pattern at most.
PLAIN = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF]+)([.,;:!?]+)?")
NONE = np.int64(1) << np.int64(62)


class Vocabulary:
    """A rank file: ids by bytes, bytes by id, and the rank of every pair of ids that may merge."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in rows}
        self.split = regex.compile(pattern)
        size = max(self.ids.values()) + 1
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.int64(2) ** 62)
        self.pair_ranks = np.array([pairs[k] for k in keys.tolist()] + [-1], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where a pair does not merge or an id is negative."""
        key = (left << 32) | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after another, and the number of ids of each piece."""
        n = len(pieces)
        whole = np.array([self.ids.get(p, -1) for p in pieces], np.int64)  # a piece that is a token needs no merge
        sizes = np.array([len(p) for p in pieces], np.int64)
        counts = (whole >= 0).astype(np.int64)
        done = [(np.flatnonzero(whole >= 0), whole[whole >= 0], counts[whole >= 0])]
        open_ = np.flatnonzero((whole < 0) & (sizes > 0))
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for width in np.unique(widths[open_]).tolist():
            members = open_[widths[open_] == width]
            step = max(1, (1 << 16) // width)
            for k in range(0, len(members), step):
                some = members[k:k + step]
                ids, kept = self._merge([pieces[i] for i in some.tolist()], width)
                counts[some] = kept
                done.append((some, ids, kept))
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for some, ids, kept in done:
            flat[np.repeat(starts[some] - (np.cumsum(kept) - kept), kept) + np.arange(len(ids))] = ids
        return flat, counts

    def _merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges pieces of at most `width` bytes, a power of two; one segment tree per piece."""
        n = len(pieces)
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces], np.int64)
        place = np.arange(width, dtype=np.int64)
        token = np.where(place < size[:, None], self.single[data], -1)  # id that starts here, or -1
        after = np.broadcast_to(place + 1, (n, width)).copy()  # where the next part starts
        before = np.broadcast_to(place - 1, (n, width)).copy()
        # leaves: rank and position of the pair that starts here, in one number
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self.ranks(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:2 * width - 1] = np.where(ranks == NONE, NONE, ranks * width + place[:-1])
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        alive = np.flatnonzero(tree[:, 1] < NONE)
        while len(alive):
            rank, at = np.divmod(tree[alive, 1], width)
            right = after[alive, at]
            beyond = after[alive, right]
            token[alive, at] = rank  # the id of the merged bytes is their rank
            token[alive, right] = -1
            after[alive, at] = beyond
            inside = beyond < width
            before[alive[inside], beyond[inside]] = at[inside]
            follower = np.where(inside, token[alive, np.minimum(beyond, width - 1)], -1)
            left = before[alive, at]
            some = left >= 0
            rows, left = alive[some], left[some]
            # point updates: the right part's pair is gone, the merged part and its left neighbour have new ones
            self._put(tree, np.concatenate([alive, alive, rows]), np.concatenate([right, at, left]), np.concatenate(
                [np.full(len(alive), NONE), *np.split(self._leaf(
                    np.concatenate([rank, token[rows, left]]), np.concatenate([follower, rank[some]]),
                    np.concatenate([at, left]), width), [len(alive)])]), width)
            alive = alive[tree[alive, 1] < NONE]
        kept = token >= 0
        return token[kept], kept.sum(axis=1)

    def _leaf(self, left, right, at, width):
        ranks = self.ranks(left, right)
        return np.where(ranks == NONE, NONE, ranks * width + at)

    @staticmethod
    def _put(tree, rows, at, value, width):
        """Point updates: distinct leaves of the named trees, then the nodes above them."""
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids; an id outside the vocabulary raises."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[shift + np.arange(total)].tobytes()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Once per Python worker."""
    return Vocabulary(path, pattern)


class Encoder:
    """Encodes texts by a vocabulary; remembers at most about `remember` distinct stretches."""

    def __init__(self, vocab: Vocabulary, remember: int = 300_000):
        self.vocab, self.remember, self.known = vocab, remember, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [self._cut(t) for t in texts]
        known = self.known
        rows = [list(map(known.get, x)) for x in cuts]
        lacking = [i for i, row in enumerate(rows) if None in row]
        fresh = {c for i in lacking for c, r in zip(cuts[i], rows[i]) if r is None}
        if len(known) + len(fresh) > self.remember:
            known.clear()
        if fresh:
            self._learn(list(fresh))
            for i in lacking:
                rows[i] = [known[c] if r is None else r for c, r in zip(cuts[i], rows[i])]
        return [np.frombuffer(b"".join(row), np.uint32) for row in rows]

    @staticmethod
    def _cut(text: str) -> list:
        """The text in stretches that the split pattern never crosses: the first in a tuple, others without their space."""
        first, *rest = CUT.split(text) if ODD_SPACES.search(text) else text.split(" ")
        return [(first,), *rest]

    def _learn(self, chunks: list) -> None:
        split, number, at = self.vocab.split.findall, {}, []
        sizes = []
        for chunk in chunks:
            chunk = " " + chunk if isinstance(chunk, str) else chunk[0]
            plain = PLAIN.fullmatch(chunk)
            if plain is None:
                pieces = split(chunk)
            else:
                pieces = plain.groups() if plain[2] else plain.groups()[:1]
            sizes.append(len(pieces))
            for piece in pieces:
                at.append(number.setdefault(piece, len(number)))
        flat, counts = self.vocab.encode_pieces([p.encode("utf-8", "surrogatepass") for p in number])
        # the ids of the pieces of each stretch, one stretch after another
        at = np.array(at, np.int64)
        starts = (np.cumsum(counts) - counts)[at]
        counts = counts[at]
        row = flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))].tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        ends = ends.tolist()
        for chunk, a, b in zip(chunks, ends, ends[1:]):
            self.known[chunk] = row[a:b]


def groups(texts: list[str], most: int = 1 << 21):
    """Consecutive texts of about `most` characters together; a longer text is a group of its own."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > most:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids (array<int>) and decoded (binary, decoded from these ids) to each row.

    A null text counts as empty: no ids, no bytes. Repeated rows are encoded
    each; other columns pass through. Columns named ids or decoded are replaced.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        vocab = vocabulary(path, pattern)
        encoder = Encoder(vocab)
        for batch in batches:
            at = 0
            for some in groups([t or "" for t in batch.column(text).to_pylist()]):
                ids = encoder.encode(some)
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep),
                     pa.array(ids, pa.list_(pa.int32())), pa.array([vocab.decode(x) for x in ids], pa.binary())],
                    names=[*keep, "ids", "decoded"])

    return docs.select(*keep).mapInArrow(run, f"{schema}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and SHA-256 of the decimal ids and of the bytes decoded from the ids, per row.

    A null text counts as empty; a null key stays null; repeated rows give a row each.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(path, pattern)
        encoder = Encoder(vocab)
        decimal = [str(i) for i in range(len(vocab.bytes))]
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for some in groups([t or "" for t in batch.column(1).to_pylist()]):
                for ids in encoder.encode(some):
                    counts.append(len(ids))
                    joined = ",".join([decimal[i] for i in ids.tolist()])
                    of_ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
