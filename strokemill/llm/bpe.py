"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once. The pieces
that a task has not met before are laid out together as one row of symbols, with an
inverted index from each adjacent pair of symbols to the places where it stands. Merges
are then replayed in the order of their ranks: the best pair left in the index is merged
at all its places at once, and only the neighbours of the touched places are indexed
anew. A piece that is a token itself gets that token right away.

Replaying a merge at all places at once differs from merging one place at a time only if
a merge makes a pair of a *better* rank; pieces where that happens are set aside and
encoded one merge at a time, so the ids are exactly those of the reference tokenizer.

Decoding looks each id up and joins the bytes.

Defined cases: null counts as the empty text (no ids); lone surrogates cannot occur in
Spark strings; special tokens are ordinary text; a piece may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, read
from .langid import Table

#: Distinct pieces that a task remembers before it starts its memory anew.
REMEMBERED = 120_000
#: Bytes of text whose pieces are gathered before merges are replayed.
GATHERED = 2 << 20


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


#: The cut that ``Cutter`` makes (fixed value); other patterns go through ``regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairTable(Table):
    """Token id of each mergeable pair."""

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = super().find(keys)
        return np.where(at < 0, -1, self.rows[at])


def character_classes() -> np.ndarray:
    """0 letter, 1 number, 2 white space, 3 other, for each code point."""
    kinds = np.full(0x110000, 3, np.uint8)
    kinds[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = 0
    kinds[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "N"]] = 1
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 2
    return kinds


class Cutter:
    """Cuts texts as ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` does.

    Runs of characters of one class are found for the whole text at once: a run of white
    space before anything else gives up its last character, which goes with the next run
    if it is a plain space; an apostrophe that begins a piece takes s, t, m, d, re, ve or
    ll from the letters that follow.
    """

    def __init__(self):
        self.kinds = character_classes()

    def __call__(self, text: str) -> list[str]:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, n = self.kinds[code], len(code)
        begins = np.empty(n, bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        to = np.flatnonzero(begins[1:]) + 1
        space = to[kind[to - 1] == 2]  # where something else follows white space
        begins[space - 1] = True
        begins[space[code[space - 1] == 32]] = False
        quote = np.flatnonzero(begins[:-1] & (code[:-1] == 39) & (kind[1:] == 0))
        for q in quote.tolist():
            tail = text[q + 1 : q + 3]
            k = 2 if tail in ("re", "ve", "ll") else 1 if tail[:1] in ("s", "t", "m", "d") else 0
            if k:
                begins[q + 1] = False
                if q + 1 + k < n:
                    begins[q + 1 + k] = True
        at = np.flatnonzero(begins).tolist()
        return [text[i:j] for i, j in itertools.pairwise([*at, n])]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), then the same for the next, in one array."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


class Pieces(dict):
    """Number of each distinct piece, in the order in which they were met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Bpe:
    def __init__(self, path: str, pattern: str):
        self.tokens = load_ranks(path)
        self.ranks = {t: i for i, t in enumerate(self.tokens) if t}
        self.cut = Cutter() if pattern == PATTERN else regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        #: every pair of tokens that makes a token, and the id of that token
        merged = ((a << 32 | b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None)
        pairs = np.fromiter(itertools.chain.from_iterable(merged), np.uint64).reshape(-1, 2)
        self.table = PairTable(pairs[:, 0].copy(), pairs[:, 1].astype(np.int64))
        self.forget()

        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.blob, self.blob_at, self.blob_len = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    def forget(self) -> None:
        """Pieces met so far, and for each the place and number of its ids in one flat array."""
        self.pieces, self.flat = Pieces(), np.zeros(0, "<u4")
        self.flat_at, self.flat_len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_of(self, pair: int) -> int:
        return self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)

    def one_by_one(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first, one merge at a time."""
        ids, n = [int(self.byte[b]) for b in piece], len(piece)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merge_of(ids[i] << 32 | ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], live[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := self.merge_of(ids[a] << 32 | ids[after[a]])) >= 0:
                    heapq.heappush(heap, (r, a, ids[a], ids[after[a]]))
        return [x for x, own in zip(ids, live, strict=True) if own]

    def _mergeable(self, pairs: np.ndarray) -> np.ndarray:
        """Ids that the pairs merge to, -1 if none."""
        if len(pairs) < 40:
            return np.array([self.merge_of(p) for p in pairs.tolist()], np.int64)
        return self.table.find(pairs.view(np.uint64))

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has, by replaying all merges in rank order."""
        if not pieces:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(sizes) - sizes
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        # one place more on either side, so that neighbours need no bounds
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        last = np.zeros(n + 1, bool)
        last[start + sizes - 1] = True
        live, odd = np.ones(n, bool), np.zeros(len(pieces), bool)
        places = np.flatnonzero(~last[:n])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, done: int) -> None:
            to = self._mergeable(ids[at] << 32 | ids[after[at]])
            at, to = at[to >= 0], to[to >= 0]
            back = to <= done
            if back.any():
                odd[owner[at[back]]] = True
                at, to = at[~back], to[~back]
            if not len(at):
                return
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(at)]
            for i, j, rank in zip(cuts, cuts[1:], to[cuts[:-1]].tolist(), strict=False):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(at[i:j])

        add(places, -1)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = distinct(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[live[at] & ~last[at]]
            if len(at):
                # places may have been touched since; the pair must still make this token
                at = at[self._mergeable(ids[at] << 32 | ids[after[at]]) == rank]
            if not len(at):
                continue
            # of places that overlap (aaa), every second one, from the left
            linked = np.zeros(len(at), bool)
            linked[1:] = after[at[:-1]] == at[1:]
            if linked.any():
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = after[at]
            ids[at] = rank
            live[gone] = False
            last[at] = last[gone]
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            left = left[(left >= 0)]
            left = left[~last[left]]
            touched = distinct(np.concatenate([left, at[~last[at]]]))
            if len(touched):
                add(touched, rank)
        flat, counts = ids[live].astype("<u4"), np.bincount(owner[live], minlength=len(pieces))
        if odd.any():
            own = np.split(flat, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd).tolist():
                own[i] = np.array(self.one_by_one(pieces[i]), "<u4")
            flat, counts = np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
        return flat, counts

    def learn(self) -> None:
        """Encode the pieces that were met since the last time."""
        new = [p.encode("utf-8") for p in itertools.islice(self.pieces, len(self.flat_len), None)]
        if not new:
            return
        whole = [self.ranks.get(p, -1) for p in new]
        ids, counts = self.replay([p for p, w in zip(new, whole, strict=True) if w < 0])
        rest = np.array(whole) < 0
        sizes = np.ones(len(new), np.int64)
        sizes[rest] = counts
        ends = np.cumsum(sizes)
        flat = np.empty(ends[-1], "<u4")
        alone = np.ones(len(flat), bool)
        alone[spread(ends[rest] - counts, counts)] = False
        flat[alone], flat[~alone] = np.array(whole)[~rest], ids
        self.flat_at = np.concatenate((self.flat_at, ends - sizes + len(self.flat)))
        self.flat_len = np.concatenate((self.flat_len, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > REMEMBERED:
            self.forget()
        number, cut = self.pieces.__getitem__, self.cut
        rows = [np.fromiter(map(number, cut(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        self.learn()
        return [self.flat[spread(self.flat_at[row], self.flat_len[row])].tobytes() for row in rows]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return self.blob[spread(self.blob_at[ids], self.blob_len[ids])].tobytes()


@lru_cache(2)
def loaded(path: str, pattern: str) -> Bpe:
    """One for each Python worker: later tasks find the pieces that earlier ones met."""
    return Bpe(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def packer(path: str, pattern: str):
    bpe = loaded(path, pattern)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bpe.encode(batch.column("text").to_pylist()), pa.binary())], names=[*names, "token_ids"])

    return work


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``docs`` but text, and token_ids (binary, little-endian unsigned 32-bit)."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    kept = [f for f in docs.schema.fields if f.name not in ("text", "token_ids")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["token_ids binary"])
    return per_text(docs.select(*[f.name for f in kept], "text"), schema, packer, path, pattern, chars=GATHERED)


def decoder(path: str, pattern: str):
    bpe = loaded(path, pattern)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        out = [None if x is None else bpe.decode(x) for x in batch.column("token_ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return work


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and decoded (binary)."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    kept = encoded.drop("decoded")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["decoded binary"])
    return per_text(kept, schema, decoder, path, pattern, chars=GATHERED)


def digests(path: str, pattern: str):
    """Encode and decode in one pass over the texts; only digests leave the task."""
    bpe = loaded(path, pattern)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = bpe.encode(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return work


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, read(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last: token counts and digests of each document that is left."""
    return per_text(docs.select("doc_id", "text"), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests, *default_vocabulary(), chars=GATHERED)
