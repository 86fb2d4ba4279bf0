"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has one valid encoding, hence one last token; a table of
these last tokens encodes the piece by walking backwards, is extended by an
append without touching what it has, and is re-used up to an edit.  A token may
end a prefix if it is valid next to the last token of what precedes it, and two
tokens are valid next to each other if merging their joint bytes by rank gives
just these two.

Texts are first cut into pieces by the tokenizer's pattern; a piece that is a
token as a whole is that token.  Encodings of pieces are remembered in a table of
bounded size.

Defined cases.  Null text counts as empty and has no tokens.  Control strings in
a text are ordinary text.  Long texts and long pieces take time in proportion to
their length.  Repeated rows repeat their result; an empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import release, small_batches, table, text_of

#: Pieces and neighbour checks remembered by a worker, at most, and places that tell whether a piece was seen (a power of two).
CACHE, PAIRS, SEEN = 200_000, 250_000, 1 << 21


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, a trie of the tokens, and which tokens are valid next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: A node maps a byte to a node; at -1 it has the token that ends there.  A node without children is its token.
        self.trie: dict = {}
        for token in sorted(ranks):  # a token comes after those that begin it
            node, inner = self.trie, token[:-1]
            for byte in inner:
                below = node.get(byte)
                if below.__class__ is int:
                    below = node[byte] = {-1: below}
                elif below is None:
                    below = node[byte] = {}
                node = below
            if token:
                node[token[-1]] = ranks[token]
        self._valid: dict[int, bool] = {}
        self._edges: dict[int, tuple[list[int], list[int]]] = {}

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """By definition: merge the adjacent pair of least rank, until no pair (or ``until`` parts) is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edges(self, token: int) -> tuple[list[int], list[int]]:
        """What stands at the first and at the last place while a token is built, by rising rank."""
        found = self._edges.get(token)
        if found is None:
            data = self.bytes_of[token]
            if len(data) == 1:
                found = ([token], [token])
            else:
                left, right = self.merged(data, until=2)
                found = ([*self.edges(left)[0], token], [*self.edges(right)[1], token])
            self._edges[token] = found
        return found

    def adjacent(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before the merges beside it."""
        key = left << 32 | right
        found = self._valid.get(key)
        if found is None:
            if len(self._valid) >= PAIRS:
                self._valid.clear()
            found = self._valid[key] = self._stay_apart(self.edges(left)[1], self.edges(right)[0])
        return found

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of each prefix of a piece, as ``PrefixTable`` builds it, in one go."""
        trie, valid, adjacent, size = self.trie, self._valid, self.adjacent, len(data)
        last, before = [-1] * size, 0
        for begin in range(size):
            node = trie
            for end in range(begin, size):
                node = node.get(data[end])
                if node is None:
                    break
                token = node if node.__class__ is int else node.get(-1)
                if token is not None and last[end] < 0:
                    if begin:
                        fits = valid.get(before << 32 | token)
                        if fits or fits is None and adjacent(before, token):
                            last[end] = token
                    else:
                        last[end] = token
                if node is token:
                    break
            before = last[begin]
            if before < 0:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def parted(self, last: list[int]) -> list[int]:
        """The encoding that last tokens of prefixes stand for, walked from the end."""
        out, end, size_of = [], len(last), self.size_of
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size_of[token]
        out.reverse()
        return out

    def _stay_apart(self, ends: list[int], starts: list[int]) -> bool:
        never, i, j = 1 << 60, 0, 0
        while True:
            across = self.ranks.get(self.bytes_of[ends[i]] + self.bytes_of[starts[j]], never)
            # A token's rank is the time at which it is built; of equal ranks the leftmost merges first.
            on_left = ends[i + 1] if i + 1 < len(ends) else never
            on_right = starts[j + 1] if j + 1 < len(starts) else never
            if across < on_left and across <= on_right and across != never:
                return False
            if on_left == on_right == never:
                return True
            if on_left <= on_right:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of each prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Entries that exist stay as they are: they depend on earlier bytes only."""
        v, old = self.vocabulary, len(self.data)
        self.data = data = self.data + more
        last, size = self.last, len(data)
        last += [-1] * (size - old)
        trie, valid, adjacent = v.trie, v._valid, v.adjacent
        for begin in range(max(0, old - v.longest + 1), size):
            before = last[begin - 1] if begin else -1
            node = trie
            for end in range(begin, size):
                node = node.get(data[end])
                if node is None:
                    break
                leaf = node.__class__ is int
                token = node if leaf else node.get(-1)
                if token is not None and end >= old and last[end] < 0:
                    if begin == 0 or (valid.get(before << 32 | token) if before << 32 | token in valid else adjacent(before, token)):
                        last[end] = token
                if leaf:
                    break
            if begin >= old and last[begin] < 0:
                raise ValueError("the vocabulary lacks a byte")
        return self

    def replace(self, begin: int, end: int, by: bytes) -> PrefixTable:
        """Re-encode near an edit: prefixes that end before it are kept, and so is the rest once the table agrees again.

        An entry follows from the bytes of at most a longest token and the entries
        there, so after as many equal entries in a row all later ones are equal.
        """
        tail, known, size = self.data[end:], self.last[end:], max(1, self.vocabulary.longest)
        self.data, self.last = self.data[:begin], self.last[:begin]
        self.append(by)
        for done in range(size, len(tail) + size, size):
            self.append(tail[done - size : done])
            if self.last[-size:] == known[done - size : done]:
                self.data += tail[done:]
                self.last += known[done:]
                break
        return self

    def tokens(self) -> list[int]:
        return self.vocabulary.parted(self.last)


class Codec:
    """Whole texts: cut by the pattern, then encode each piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary, self.pieces = Vocabulary(ranks), regex.compile(pattern).findall
        self._known: dict[str, tuple[int, ...]] = {}
        self._seen = bytearray(SEEN)
        self.shown = {rank: str(rank) for rank in self.vocabulary.bytes_of}

    def _learn(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        found = (whole,) if whole is not None else tuple(self.vocabulary.parted(self.vocabulary.last_tokens(data)))
        # Most pieces occur once, so one is remembered from its second time on (or where it shares a place with one).
        place = hash(piece) & (SEEN - 1)
        if self._seen[place]:
            if len(self._known) >= CACHE:
                # The older half goes; dictionaries keep the order of insertion.
                for old in list(islice(self._known, CACHE // 2)):
                    del self._known[old]
            if len(piece) <= 64:
                self._known[piece] = found
        self._seen[place] = 1
        return found

    def encode(self, text: str) -> list[int]:
        known, out = self._known.get, []
        for piece in self.pieces(text):
            out += known(piece) or self._learn(piece)
        return out

    def forget(self) -> None:
        """What was remembered goes; the vocabulary stays."""
        self._known.clear()
        self._seen = bytearray(SEEN)
        self.vocabulary._valid.clear()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One for each worker and vocabulary; the file's bytes come with the task."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
    return Codec(ranks, pattern)


def rank_file_bytes(path: str, most: int = 64 << 20) -> bytes:
    """Read on the driver and broadcast, so executors need no file; its size is checked."""
    with open(path, "rb") as file:
        found = file.read(most + 1)
    if len(found) > most:
        raise ValueError(f"{path}: a rank file of over {most} bytes")
    return found


def _listed(encoded: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, encoded)])
    flat = np.fromiter((t for ids in encoded for t in ids), np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, ids array<int>`` for each row."""
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(rank_file_bytes(path))

    def run(batches):
        codec = _codec(file.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed([codec.encode(t.as_py()) for t in batch.column(1)])], ["id", "ids"])
        codec.forget()
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``id, data binary`` from ``id, ids``; null ids are none."""
    small_batches(encoded.sparkSession)
    file = encoded.sparkSession.sparkContext.broadcast(rank_file_bytes(path))

    def run(batches):
        codec = _codec(file.value, "")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(i.as_py() or []) for i in batch.column(1)], pa.binary())], ["id", "data"])

    return encoded.select(F.col("id").cast("long").alias("id"), "ids").mapInArrow(run, "id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded within a batch, so token lists never move."""
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(rank_file_bytes(path))

    def run(batches):
        codec = _codec(file.value, pattern)
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(codec.shown.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_files() -> tuple[str, str]:
    """Rank file and pattern of the public tokenizer that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_files())
