"""Byte-level BPE encoding and decoding by prefix dynamic programming, and exact appends and edits.

For every byte prefix of a piece there is one valid last token: the token that ends the prefix's encoding.
A token t ending at byte i, after the prefix ending at j with last token p, is valid if and only if the bytes of p
and t together encode as [p, t]. So a table with one token per prefix gives the encoding of every prefix, an append
only fills new entries, and an edit refills from the first changed byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.llm.arrow import per_row, texts, tidy

#: Entries of a worker's memories; chunks, pieces and pairs of tokens have two generations of so many.
CHUNKS, PIECES, PAIRS, MOVES, STEMS = 600_000, 50_000, 400_000, 200_000, 200_000
#: Tables of a piece's beginning are remembered at every STEM bytes, up to STEM_END.
STEM, STEM_END = 3, 24
MARKS = frozenset("!\"#%&()*,-./:;?@[\\]_{}'")

#: A pattern whose pieces hold a space before a non-space only as their first byte, so that texts can be cut there.
SPACE_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Memo(dict):
    """Remembers ``fn`` in two generations: when the young one is full it becomes the old one, whose used entries return."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value


class Codec:
    """Encoder and decoder for one vocabulary: ``ranks`` maps token bytes to ids, ``pattern`` cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: float = 1.0):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.bytes_of[r] = token
        self.split = regex.compile(pattern).findall
        self.cut = re.compile(r" (?=\S)").split if pattern == SPACE_FIRST else lambda text: [text]
        self.pieces = _Memo(lambda piece: tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass"))), int(PIECES * memory))
        self.chunks = _Memo(self._chunk, int(CHUNKS * memory))
        self.sizes = list(map(len, self.bytes_of))
        self.pairs = _Memo(lambda key: self._apart(self.bytes_of[key >> 32], self.bytes_of[key & 0xFFFFFFFF]), int(PAIRS * memory))
        self.moves = _Memo(lambda key: self._move(self.heads[key >> 8] + bytes((key & 255,))), int(MOVES * memory))
        self.ending = _Memo(self._ending, int(PAIRS * memory))
        self.stems = _Memo(self._stem, int(STEMS * memory))

    @cached_property
    def names(self) -> list[str]:
        return [str(i) for i in range(len(self.bytes_of))]

    @cached_property
    def heads(self) -> list[bytes]:
        """Every beginning of every token; the automaton's states are their numbers, and 0 is the empty one."""
        return sorted({t[:i] for t in self.ranks for i in range(len(t) + 1)})

    @cached_property
    def states(self) -> dict[bytes, int]:
        return {h: k for k, h in enumerate(self.heads)}

    def _move(self, data: bytes) -> int:
        """State of the longest ending of ``data`` that some token begins with."""
        while data not in self.states:
            data = data[1:]
        return self.states[data]

    def _ending(self, state: int) -> tuple[int, ...]:
        """Tokens that a state's bytes end with, the longest first, without those that never stand in an encoding."""
        data = self.heads[state]
        found = (self.ranks.get(data[i:]) for i in range(len(data)))
        return tuple(t for t in found if t is not None and self._merge(self.bytes_of[t]) == [0])

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha():  # a space and letters are one piece
            return tuple(self.encode_piece(b" " + chunk.encode()))
        if chunk[-1] in MARKS and chunk[:-1].isalpha():  # two pieces; a mark alone begins none of the pattern's endings
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(" " + chunk))))

    def _merge(self, data: bytes, seam: int = 0) -> list[int] | None:
        """The merge rule itself, for the few bytes of one or two tokens: where the parts start.

        None as soon as a merge takes away the start at ``seam``.
        """
        get, none = self.ranks.get, 1 << 60
        at = list(range(len(data)))
        low = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while low and (rank := min(low)) != none:
            i = low.index(rank)
            if at.pop(i + 1) == seam:
                return None
            del low[i]
            after = at[i + 1 : i + 3]
            if after:
                low[i] = get(data[at[i] : after[1] if len(after) > 1 else len(data)], none)
            if i:
                low[i - 1] = get(data[at[i - 1] : after[0] if after else len(data)], none)
        return at

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens that each encode as themselves stay apart when they meet."""
        return left + right not in self.ranks and self._merge(left + right, len(left)) is not None

    def fill(self, data: bytes, last: list[int]) -> None:
        """Extend ``last`` (last[i]: the last token of data[:i]; last[0] is -1) to all of ``data``."""
        i = len(last)
        self._fill(data, last, self._move(data[: i - 1][-max(self.sizes) :]) if i > 1 else 0)

    def _fill(self, data: bytes, last: list[int], state: int) -> int:
        """``fill`` from the automaton's state at the end of ``last``; the state at the end of ``data``."""
        moves, ending, sizes, pairs = self.moves, self.ending, self.sizes, self.pairs
        i = len(last)
        for byte in data[i - 1 :]:
            state = moves[state << 8 | byte]
            for t in ending[state]:
                j = i - sizes[t]
                if not j or pairs[last[j] << 32 | t]:
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {data[:i][-20:]!r}")
            last.append(t)
            i += 1
        return state

    def _stem(self, data: bytes) -> tuple[int, tuple[int, ...]]:
        """State and table of a piece's beginning, from those of its own beginning: pieces share them."""
        cut = (len(data) - 1) // STEM * STEM
        state, table = self.stems[data[:cut]] if cut else (0, (-1,))
        last = list(table)
        return self._fill(data, last, state), tuple(last)

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        out, i, sizes = [], len(data), self.sizes
        while i:
            t = last[i]
            out.append(t)
            i -= sizes[t]
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        cut = min((len(data) - 1) // STEM * STEM, STEM_END)
        state, table = self.stems[data[:cut]] if cut > 0 else (0, (-1,))
        last = list(table)
        self._fill(data, last, state)
        return self.walk(data, last)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null encodes as the empty text."""
        return list(chain.from_iterable(self._parts(text))) if text else []

    def _parts(self, text: str) -> Iterator[tuple[int, ...]]:
        first, *rest = self.cut(text)
        return chain(map(self.pieces.__getitem__, self.split(first)), map(self.chunks.__getitem__, rest))

    def count(self, text: str | None) -> int:
        return sum(map(len, self._parts(text))) if text else 0

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Buffer:
    """One piece's bytes with its prefix table: exact appends, truncation and edits without encoding it all again."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.codec.fill(self.data, self.last)

    def edit(self, start: int, removed: int, inserted: bytes) -> None:
        """Replace ``removed`` bytes at ``start``. Only prefixes that end after ``start`` are computed again."""
        self.data = self.data[:start] + inserted + self.data[start + removed :]
        del self.last[start + 1 :]
        self.codec.fill(self.data, self.last)

    def count(self, end: int | None = None) -> int:
        return len(self.ids(end))

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes."""
        end = len(self.data) if end is None else end
        if (whole := self.codec.ranks.get(self.data[:end])) is not None:
            return [whole]
        return self.codec.walk(self.data[:end], self.last)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_codecs: dict[tuple[str, str], Codec] = {}


class Vocabulary:
    """A vocabulary file read on the driver and broadcast (its size is that of the file, about 1 MB).

    ``memory`` scales what an encoder remembers: less takes more time, never other ids.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, memory: float = 1.0):
        with open(path, "rb") as f:
            data = f.read()
        self.sent = spark.sparkContext.broadcast(data)
        self.key = (hashlib.md5(data).hexdigest(), pattern, memory)
        self.pattern, self.memory = pattern, memory

    def codec(self) -> Codec:
        """One codec per worker process and vocabulary."""
        if self.key not in _codecs:
            _codecs[self.key] = Codec(read_ranks(self.sent.value), self.pattern, self.memory)
        return _codecs[self.key]


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", exact: str | None = None) -> DataFrame:
    """All columns of ``df`` but ``text``, then ``ids`` array<int>. Null and empty texts give an empty array.

    With ``exact``, a boolean of that name tells whether the ids decode to the text's bytes. Rows are independent: repeats
    give repeats, an empty table gives an empty table. Columns of ``df`` that are already named so are replaced.
    """
    keep = [c for c in df.columns if c not in (text, ids, exact)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if exact:
        schema.add(exact, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = vocabulary.codec()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                got = [c.encode(x.as_py()) for x in part.column(text)]
                out = [pa.array(got, pa.list_(pa.int32()))]
                if exact:
                    out.append(pa.array([c.decode(v) == (x.as_py() or "").encode("utf-8", "surrogatepass") for v, x in zip(got, part.column(text), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + out, names=schema.names)
        _codecs.clear()  # a worker serves later stages too; its memories go with the task

    return texts(df.select(*keep, F.col(text))).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``out`` binary, the bytes that the ids stand for (null ids: null)."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = vocabulary.codec()
        for batch in batches:
            got = [None if (v := x.as_py()) is None else c.decode(v) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(got, pa.binary())], names=[*keep, out])
        _codecs.clear()

    return df.select(*keep).mapInArrow(tidy(run), schema)


def round_trip(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encode each whole text, decode the ids, and digest both.

    Null text counts as empty; null keys stay null; extra columns are not read. Each row gives one row.
    """
    kind = pa.int64() if isinstance(df.schema[key].dataType, T.LongType) else None
    if kind is None:
        df = df.withColumn(key, F.col(key).cast("long"))
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def one(value: str | None) -> tuple[int, str, str]:
        c = vocabulary.codec()
        ids = c.encode(value)
        named = ",".join(map(c.names.__getitem__, ids))
        return len(ids), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    out = texts(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(tidy(per_row(one, schema, "text", keep=("key",))), "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def token_counts(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "n_tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``out`` long, the encoded length of each whole text (null: 0)."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = vocabulary.codec()
        for batch in batches:
            got = pa.array([c.count(x.as_py()) for x in batch.column("__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [got], names=[*keep, out])

    return texts(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(tidy(run), schema)
