"""Byte-level BPE from a rank file, folded by Spark's higher-order functions over the distinct words of a task's texts.

A task's Python finds the tokens that stand anywhere in a word of up to SHORT bytes, by their ranks and then from the left;
the fold goes through them once and joins those that are two parts at their turn (see `settle`), in one number a word.

A longer word is the string of its bytes, one character a byte (ISO-8859-1). Its parts are a list of cuts; each step of its
fold joins the leftmost pair of the least rank and looks only the two new pairs up; a task's Python looks up the pairs of bytes
in which it begins, and words that are tokens. The rank map is a literal of the plan: an
array of small maps by checksum, since a lookup in one map takes time in its size. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, joined, latin_split, rows_of

#: The rank of a pair that is no token; real ones are below it. What a rank and a start count for in a fold's numbers.
NONE = 1 << 24
RANK, START = 1 << 32, 1 << 24
#: Longer words are merged by a heap in the task instead, since a fold takes time in the square of a word's length.
LONGEST = 128
#: Words up to here are settled in one number: bit i stands for the cut before byte i, and bit 32 + i for the same again.
SHORT = 30
BOTH, FLAG = (1 << 32) + 1, 1 << 31


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, which are the ids, from lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_maps(ranks: dict[bytes, int]) -> tuple[Column, int]:
    """The literal rank map: an array of small maps, with about one entry each, and their number."""
    n = 1 << max(1, len(ranks)).bit_length()
    buckets: list[dict[str, int]] = [{} for _ in range(n)]
    for token, rank in ranks.items():
        word = token.decode("latin-1")
        buckets[zlib.crc32(word.encode()) % n][word] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>"), n


def rank_lookup(maps: Column, n: int) -> Callable[[Column], Column]:
    """Word to rank, or NONE, from the ``n`` maps of `rank_maps`."""

    def rank(word: Column) -> Column:
        bucket = F.element_at(maps, (F.crc32(word.cast("binary")) % n + 1).cast("int"))
        return F.coalesce(F.element_at(bucket, word), F.lit(NONE))

    return rank


def byte_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of single bytes and of pairs of bytes, each by its bytes' number."""
    single = [ranks[bytes([b])] for b in range(256)]
    return np.array(single), np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)])


def begin(words: list[bytes], single: np.ndarray, pairs: np.ndarray) -> pa.ListArray:
    """The states in which the folds of words of up to LONGEST bytes begin: a part for each byte; see `fold` and `byte_ranks`."""
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    rank = np.full(len(raw), NONE, np.int64)
    if len(raw):
        rank[:-1] = pairs[raw[:-1] * 256 + raw[1:]]
        rank[ends - 1] = NONE
    places = np.arange(len(raw)) - np.repeat(ends - sizes, sizes) + 1
    ends_of = ends + np.arange(len(words))  # each word's parts are followed by one for its end
    state = np.empty(len(raw) + len(words), np.int64)
    state[ends_of] = NONE * RANK + (sizes + 1) * START
    state[np.delete(np.arange(len(state)), ends_of)] = rank * RANK + places * START + single[raw]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends_of + 1), pa.int32()), pa.array(state))


def fold(word: Column, begun: Column, rank: Callable[[Column], Column]) -> Column:
    """The ids (array<int>) of one word, folded from the state in which it begins.

    A state has one number a part: the rank of its pair with the next part, above its start, above its id; and one for the
    word's end. The least number is then the leftmost pair of the least rank, which is the id of the two joined.
    """
    at = F.element_at
    between = lambda lo, hi: F.substring(word, lo, hi - lo)
    start = lambda state, i: F.shiftright(at(state, i), 24).bitwiseAND(255).cast("int")
    known = lambda state, i: at(state, i).bitwiseAND(RANK - 1)

    def step(state: Column, _: Column) -> Column:
        def merge(i: Column) -> Column:
            after = F.when(i + 2 < F.size(state), rank(between(start(state, i), start(state, i + 3)))).otherwise(NONE)
            whole = after.cast("long") * RANK + at(state, i).bitwiseAND(255 * START) + F.shiftright(at(state, i), 32)
            before = lambda: rank(between(start(state, i - 1), start(state, i + 2))).cast("long") * RANK + known(state, i - 1)
            first = F.array(F.array(whole), F.slice(state, 3, F.size(state)))
            later = F.array(F.slice(state, 1, i - 2), F.array(before(), whole), F.slice(state, i + 2, F.size(state)))
            return F.flatten(F.when(i == 1, first).otherwise(later))

        least = F.array_min(state)
        return F.when(least < NONE * RANK, let(F.array_position(state, least).cast("int"), merge)).otherwise(state)

    ids = lambda state: F.transform(F.slice(state, 1, F.size(state) - 1), lambda x: x.bitwiseAND(START - 1).cast("int"))
    return F.aggregate(F.sequence(F.lit(3), F.size(begun)), begun, step, ids)


class Tokens:
    """The tokens as a tree of their bytes: sorted steps (node * 256 + byte), the nodes they lead to, and every node's rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        nodes, steps = {b"": 0}, []
        for token in ranks:
            for i in range(1, len(token) + 1):
                if token[:i] not in nodes:
                    nodes[token[:i]] = len(nodes)
                    steps.append(nodes[token[: i - 1]] * 256 + token[i - 1])
        order = np.argsort(steps)
        self.steps, self.kids = np.array(steps, np.int64)[order], order + 1
        self.rank = np.fromiter((ranks.get(p, NONE) for p in nodes), np.int64, len(nodes))
        self.one = self.child(np.zeros(256, np.int64), np.arange(256))
        self.two = self.child(np.repeat(self.one, 256), np.tile(np.arange(256), 256))

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes one byte on, or -1."""
        step = node * 256 + byte
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        return np.where((self.steps[at] == step) & (node >= 0), self.kids[at], -1)

    def found(self, raw: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        """For words of up to SHORT bytes each, end to end: their tokens of two bytes or more by rank and from the left, as `settle` reads them."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[word] - place
        at, size, hits = np.flatnonzero(left > 1), 2, [(np.empty(0, np.int64),) * 3]
        node = self.two[raw[at] * 256 + raw[at + 1]]
        while len(at):
            rank = self.rank[node]  # of no node: any, and left out below
            hit = (node >= 0) & (rank < NONE)
            hits.append((at[hit], np.full(np.count_nonzero(hit), size), rank[hit]))
            more = (node >= 0) & (left[at] > size)
            at, node = at[more], node[more]
            node = self.child(node, raw[at + size])
            size += 1
        at, size, rank = map(np.concatenate, zip(*hits, strict=True))
        order = np.argsort(word[at] << 29 | rank << 5 | place[at])
        lo = place[at][order]
        hi = lo + size[order]
        values = ((1 << lo) | (1 << hi)) << 32 | ((1 << hi) - (2 << lo))
        ends = np.append(0, np.cumsum(np.bincount(word[at], minlength=len(sizes))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))

    def spelled(self, raw: np.ndarray, sizes: np.ndarray, joined_cuts: np.ndarray) -> pa.ListArray:
        """The ids of the words' parts, after `settle` has told which cuts are gone."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.flatnonzero((joined_cuts[word] >> place) & 1 == 0)
        lengths = np.diff(np.append(starts, len(raw)))
        node = self.one[raw[starts]]
        for i in range(1, int(lengths.max(initial=1))):
            more = np.flatnonzero(lengths > i)
            node[more] = self.child(node[more], raw[starts[more] + i])
        ends = np.append(0, np.cumsum(np.bincount(word[starts], minlength=len(sizes))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.rank[node], pa.int32()))


def settle(tokens: Column) -> Column:
    """The cuts that are gone from a word (bits, each twice) when its ``tokens`` have been joined, by rank and from the left.

    A token is its two outer cuts, 32 bits up, and the cuts inside it. It is joined at its turn if its outer cuts are left and
    one inner cut. If more are left, it might yet come to be two parts after tokens of higher rank; only a word in which that
    is so takes, for each join anew, the first token that is two parts.
    """
    whole = lambda gone, c: c.bitwiseAND(gone) < 1 << 32
    rest = lambda gone, c: c.bitwiseXOR(c.bitwiseAND(gone))
    pair = lambda gone, c: F.bit_count(rest(gone, c)) == 3
    join = lambda gone, c: gone.bitwiseOR(rest(gone, c).bitwiseAND(FLAG - 1) * BOTH)
    none = F.lit(0).cast("long")

    def step(gone: Column, c: Column) -> Column:
        return F.when(whole(gone, c), F.when(pair(gone, c), join(gone, c)).otherwise(gone.bitwiseOR(FLAG))).otherwise(gone)

    def anew(gone: Column, _: Column) -> Column:
        first = F.get(F.filter(tokens, lambda c: whole(gone, c) & pair(gone, c)), F.lit(0))
        return let(first, lambda c: F.when(c.isNull(), gone).otherwise(join(gone, c)))

    again = F.aggregate(F.sequence(F.lit(2), F.lit(SHORT)), none, anew)
    return F.aggregate(tokens, none, step, lambda gone: F.when(gone.bitwiseAND(FLAG) == 0, gone).otherwise(again))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of pairs; for words too long to fold."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the part that starts here; a joined part's end is 0
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        hi = end[i] < n and end[end[i]]
        if hi and (r := ranks.get(word[i:hi])) is not None:
            heapq.heappush(heap, (r, i, hi))

    while heap:
        _, i, hi = heapq.heappop(heap)
        if not end[i] or end[i] == n or end[end[i]] != hi or end[i] == hi:
            continue
        end[end[i]], end[i] = 0, hi
        if hi < n:
            before[hi] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches whose ``column`` holds about ``size`` bytes, small ones joined and large ones cut; a longer text is one alone."""
    for batch in joined(batches, column, size):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


#: A task forgets the words it has numbered beyond so many of them, or so many characters.
WORDS, CHARS = 1_000_000, 32_000_000
BLOCK = "fresh boolean, raw binary, keys array<{key}>, counts array<int>, at array<int>, sizes array<int>, tokens array<array<bigint>>"
BLOCK += ", words array<string>, begun array<array<bigint>>, places array<int>, far array<array<int>>"

class Told:
    """The ids of the words a task has numbered, end to end in arrays that double when they are full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.starts, self.sizes, self.flat = (np.empty(1024, np.int32) for _ in range(3))

    def add(self, near: pa.Array, places: np.ndarray, far: pa.Array) -> None:
        """The next words' ids: those of ``near``, but at ``places`` those of ``far``."""
        starts, sizes = near.offsets.to_numpy()[:-1] - near.offsets[0].as_py(), np.diff(near.offsets.to_numpy())
        ids = near.flatten().to_numpy()
        starts, sizes = starts.astype(np.int32), sizes.astype(np.int32)
        starts[places], sizes[places] = far.offsets.to_numpy()[:-1] - far.offsets[0].as_py() + len(ids), np.diff(far.offsets.to_numpy())
        ids = np.concatenate([ids, far.flatten().to_numpy()])
        for name, at, more in (("starts", self.n, starts + self.used), ("sizes", self.n, sizes), ("flat", self.used, ids)):
            held = getattr(self, name)
            if at + len(more) > len(held):
                held = np.resize(held, 2 * (at + len(more)))
                setattr(self, name, held)
            held[at : at + len(more)] = more
        self.n, self.used = self.n + len(sizes), self.used + len(ids)

    def spell(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of words end to end, and where each word's begin (and the last one's end)."""
        n = self.sizes[words]
        upto = np.append(0, np.cumsum(n))
        return self.flat[np.repeat(self.starts[words] - upto[:-1], n) + np.arange(upto[-1])], upto


def encode(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", block: int = 2_000_000) -> DataFrame:
    """(key, ids array<int>, packed binary) of every row; ``packed`` has the ids as little-endian unsigned 32-bit values.

    A task cuts blocks of ``block`` bytes, or one longer text, into words and numbers the words; a block carries only those
    that the task has not met, up to WORDS of them, so the fold runs once for each distinct word of a task. A null or empty
    text has no ids; repeated rows and null keys stay as they are; other columns are ignored. Nothing is shuffled, and only
    the rank file, whose size does not depend on the data, is sent out.
    """
    ranks = read_ranks(ranks_path)
    sent = df.sparkSession.sparkContext.broadcast((ranks, Tokens(ranks)))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_all, split_latin = regex.compile(SPLIT), latin_split()
        ranks, held = sent.value
        tables, number = byte_ranks(ranks), dict[str, int]()
        chars, fresh = 0, True
        for batch in sliced(batches, "text", block):
            counts, at, before = [], [], len(number)
            for said in rows_of(batch, "text"):
                said = said or ""
                pieces = (split_latin if said.isascii() or max(said) < "Ā" else split_all).findall(said)
                counts.append(len(pieces))
                at.append(np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int32, len(pieces)))
            words = [w.encode() for w in islice(number, before, None)]
            far = [i for i, w in enumerate(words) if len(w) > LONGEST or w in ranks]
            known = set(far)
            long = [i for i, w in enumerate(words) if len(w) > SHORT and i not in known]
            short = words.copy()
            for i in far + long:  # their places are left empty
                short[i] = b""
            raw, sizes = b"".join(short), np.fromiter(map(len, short), np.int64, len(short))
            ends = np.append(0, np.cumsum(sizes))
            bits = np.frombuffer(raw, np.uint8).astype(np.int64)
            some = range(0, len(short), 20_000)
            found = [held.found(bits[ends[i] : ends[min(i + 20_000, len(short))]], sizes[i : i + 20_000]) for i in some]
            cols = [
                batch["key"],
                pa.array(counts, pa.int32()),
                pa.array(np.concatenate(at)),
                pa.array(sizes, pa.int32()),
                pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int64())),
                pa.array([words[i].decode("latin-1") for i in long], pa.string()),
                begin([words[i] for i in long], *tables),
                pa.array(long + far, pa.int32()),
                pa.array([heap_merge(words[i], ranks) for i in far], pa.list_(pa.int32())),
            ]
            one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
            names = ["fresh", "raw", "keys", "counts", "at", "sizes", "tokens", "words", "begun", "places", "far"]
            yield pa.RecordBatch.from_arrays([pa.array([fresh]), pa.array([raw], pa.binary()), *one], names=names)
            chars += sum(map(len, words))
            fresh = len(number) > WORDS or chars > CHARS
            if fresh:
                number, chars = {}, 0

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, held = Told(), sent.value[1]
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            if row["fresh"][0].as_py():
                told.clear()
            raw = np.frombuffer(row["raw"][0].as_py(), np.uint8).astype(np.int64)
            near = held.spelled(raw, row["sizes"].flatten().to_numpy().astype(np.int64), row["gone"].flatten().to_numpy())
            told.add(near, row["places"].flatten().to_numpy(), pa.concat_arrays([row["ids"].flatten(), row["far"].flatten()]))
            keys, counts, at = row["keys"].flatten(), row["counts"].flatten().to_numpy(), row["at"].flatten().to_numpy()
            ends = np.cumsum(counts)
            lo = 0
            while lo < len(counts):  # about a million words at a time, or one longer text
                first = ends[lo] - counts[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, first + 1_000_000, "right")))
                ids, upto = told.spell(at[first : ends[hi - 1]])
                edge = upto[np.append(ends[lo:hi] - counts[lo:hi], ends[hi - 1]) - first].astype(np.int32)
                raw = [None, pa.py_buffer((4 * edge).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, raw)
                cols = [keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edge), pa.array(ids)), packed]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "packed"])
                lo = hi

    maps, n = rank_maps(ranks)
    blocks = rows.mapInArrow(cut, BLOCK.format(key=kind))
    # The maps are bound once, so that the plan holds one literal however often a fold looks ranks up.
    ids = let(maps, lambda m: F.zip_with("words", "begun", lambda w, b: fold(w, b, rank_lookup(m, n))))
    # A task's blocks stay in their order between the two, as nothing is shuffled.
    gone = F.transform("tokens", settle)
    folded = blocks.select("fresh", "raw", "keys", "counts", "at", "sizes", gone.alias("gone"), ids.alias("ids"), "places", "far")
    return folded.mapInArrow(spread, f"`{key}` {kind}, ids array<int>, packed binary")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``df`` and ``decoded`` (binary): the bytes of the column ``ids`` end to end; null ids give null, an unknown id an error."""
    ranks = read_ranks(ranks_path)
    pieces = [""] * (1 + max(ranks.values(), default=-1))
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    held = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return df.withColumn("decoded", F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.element_at(held, i + 1)), "")))


def round_trip(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the packed ids and of the decoded bytes."""
    out = decode(encode(df, ranks_path, key, text), ranks_path)
    return out.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
