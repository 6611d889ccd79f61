"""Byte-level BPE encoding and decoding through a pair occurrence index.

The distinct pieces of a block of texts lie end to end in one array. An index maps each pair's rank to all positions where
the pair occurs. The active ranks are applied in ascending order: one vector step merges every occurrence of a pair, and
only the occurrence lists of the neighbours it touched change. Vocabularies are read, never trained.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def latin_split() -> re.Pattern[str]:
    """SPLIT for texts without characters over U+00FF: the same pieces, from explicit classes that ``re`` runs faster."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    letter, digit, space = kinds.values()
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, built by their rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Numbers pieces in order of arrival; ``fresh`` lists those that are new since it was last taken."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = at = len(self)
        return at


class ByteBPE:
    """Encoder and decoder of one byte-level BPE vocabulary in the tokenizers library's JSON form.

    Encodes as that library does with add_special_tokens=False: added tokens named in a text become their ids. ``cache``
    bounds the number of pieces remembered between blocks; it changes speed only.
    """

    def __init__(self, spec: bytes, cache: int = 400_000):
        spec = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token = [b""] * self.size
        for s, i in vocab.items():
            self.token[i] = as_bytes(s) if all(c in alphabet for c in s) else s.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.added.items():
            self.token[i] = s.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = self.left * self.size + self.right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.byte_id = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.byte_rank = self.rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).astype(np.int32)
        self.words, self.latin_words = regex.compile(SPLIT), latin_split()
        self.names = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces, self.ids_of = Pieces(), []
        self.cache = cache

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each non-empty piece, as little-endian unsigned 32-bit values."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        tok = self.byte_id[raw]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[np.append(0, ends[:-1])] = -1
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self.byte_rank[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        rank[ends - 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(where: np.ndarray, ranks: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            where, ranks = where[by], ranks[by]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cut.tolist()]
            for r, lo, hi in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                if (known := index.get(r)) is None:
                    index[r] = [where[lo:hi]]
                    heapq.heappush(heap, r)
                else:
                    known.append(where[lo:hi])

        if len(at := np.flatnonzero(rank >= 0).astype(np.int32)):
            note(at, rank[at])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if a == b:
                p = np.unique(p)
            q = nxt[p]
            ok = (tok[p] == a) & (q >= 0)
            ok &= tok[q] == b
            if not ok.all():
                p, q = p[ok], q[ok]
            if a == b and len(p) > 1:
                start = np.append(True, p[1:] != q[:-1])
                i = np.arange(len(p))
                even = (i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0
                p, q = p[even], q[even]
            if not len(p):
                continue
            after = nxt[q]
            tok[p], tok[q] = self.made[r], -1
            nxt[p] = after
            more = after >= 0
            prv[after[more]] = p[more]
            before = prv[p]
            near = np.concatenate([before[before >= 0], p[more]])
            if len(near):
                ranks = self.rank(tok[near], tok[nxt[near]])
                if len(hit := np.flatnonzero(ranks >= 0)):
                    note(near[hit], ranks[hit])
        live = tok >= 0
        upto = (4 * np.append(0, np.cumsum(live))[ends]).tolist()
        ids = tok[live].astype("<u4").tobytes()
        return [ids[lo:hi] for lo, hi in zip([0, *upto[:-1]], upto, strict=True)]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.latin_words.findall(text)

    def encode_block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; merges the block's new pieces together."""
        if len(self.pieces) > self.cache:
            self.pieces, self.ids_of = Pieces(), []
        split, number = self.split, self.pieces.__getitem__
        parts: list[list[list[int] | int]] = []
        for text in texts:
            segments = [text]
            if self.names and any(s in text for s in self.added):
                segments = self.names.split(text)
            parts.append([self.added[s] if s in self.added else list(map(number, split(s))) for s in segments])
        if self.pieces.fresh:
            self.ids_of += self.merge([w.encode() for w in self.pieces.fresh])
            self.pieces.fresh = []
        ids_of = self.ids_of.__getitem__
        for segments in parts:
            out = [b"".join(map(ids_of, x)) if isinstance(x, list) else np.uint32(x).tobytes() for x in segments]
            yield np.frombuffer(out[0] if len(out) == 1 else b"".join(out), "<u4")

    def encode_all(self, texts: Iterator[str | None], block: int = 4_000_000) -> Iterator[np.ndarray]:
        """The ids of each text; blocks hold at most ``block`` characters, or one longer text. Null counts as empty."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > block:
                yield from self.encode_block(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self.encode_block(held)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def rank_encoder(bpe: ByteBPE):
    """A function from a text to its ids in compiled code (tiktoken), or ``bpe``'s own where the vocabulary does not allow it.

    It needs ids that follow the order of the merges, as byte-level vocabularies have them; the ids are then the ranks.
    """
    special = {s: i for s, i in bpe.added.items()}
    ranks = {t: i for i, t in enumerate(bpe.token) if t and i not in special.values()}
    ordered = len(ranks) == 256 + len(bpe.made) and (np.diff(bpe.made) > 0).all() and (np.sort(bpe.byte_id) == np.arange(256)).all()
    if not ordered:
        return lambda text: next(bpe.encode_block([text]))
    import tiktoken

    one = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode_one(text: str) -> np.ndarray:
        try:
            return one.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regex engine's stack ends at about a million whitespace characters in a row
            return next(bpe.encode_block([text]))

    return encode_one


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def rows_of(batch: pa.RecordBatch, column: str, step: int = 256) -> Iterator[str | None]:
    """The strings of a column, turned to Python a few at a time."""
    col = batch[column]
    for lo in range(0, len(col), step):
        yield from col.slice(lo, step).to_pylist()


def joined(batches: Iterator[pa.RecordBatch], column: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches put together until ``column`` holds ``size`` bytes, so that short texts still fill an encoder's block."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch[column].nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row: the ids of its text, none for a null text.

    Repeated rows and null keys stay as they are; other columns are ignored. No shuffle: each task encodes the rows it
    scans. The vocabulary, read once on the driver, is all that is broadcast, so its size does not depend on the data.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(sent.value)
        for batch in joined(batches, "text"):
            held = list(bpe.encode_all(rows_of(batch, "text")))
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            flat = np.concatenate([*held, np.zeros(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` and ``decoded``: the text of its column ``ids``, special tokens included; null ids give null."""
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = StructType([*df.schema.fields]).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [None if x is None else bpe.decode(x) for x in part[ids].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, from the columns that `encode` and `decode` give.

    ids_sha256 is the digest of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. A null text
    counts as empty: no tokens and the digest of nothing.
    """
    out = decode(encode(df, vocabulary, key, text), vocabulary)
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
