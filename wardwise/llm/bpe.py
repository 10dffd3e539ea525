"""Byte-level BPE by prefix dynamic programming: encode, decode, append, edit.

For every prefix of a piece exactly one token can come last in the encoding of
that prefix. The table of those tokens *is* the encoding: it is read back to
front. Extending a piece extends its table; a prefix that an edit leaves alone
keeps its rows.

A token may follow another if merging their joint bytes gives back these two.
That is decided by undoing merges at the seam, newest first: at each point in
time the two tokens that touch the seam must not have merged with one another
before one of them was merged away from it.

Text is cut into pieces first; a piece that is itself in the vocabulary is that
one token. ``Text`` keeps pieces and tables, for exact appends and edits.

Null texts are empty texts: no tokens. Any string encodes, and decodes to its
UTF-8 bytes. Repeated rows give repeated rows, an empty table an empty one, and
columns of other names pass through ``encode`` untouched.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from wardwise.llm.common import LOADED, Memo, per_batch

NEVER = 1 << 40
PIECE_MEMORY = 200_000
RUN_MEMORY = 300_000
SEAM_MEMORY = 600_000
HEAD_MEMORY, HEADS = 250_000, (10, 7, 5, 3)  # prefixes of so many bytes
#: the tokenizer's white space: Unicode's, without the four ASCII separators
SPACE = r"\p{White_Space}"


def exact_spaces(pattern: str) -> str:
    """Python's ``\\s`` has four control characters more than the property."""
    return pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", SPACE).replace(r"\S", rf"[^{SPACE}]")


class Vocabulary:
    """Ranks of byte strings, with what the table needs to know about tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.width = len(self.bytes_of)
        self.seams: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[int, ...]] = {}
        #: token and next byte to the token that is one byte longer
        self.longer = {ranks[t[:-1]] << 8 | t[-1]: i for t, i in ranks.items() if t[:-1] in ranks}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (-1, -1) for a byte.

        None if merging its bytes never arrives at the token.
        """
        if token not in self.halves:
            self.halves[token] = self._split(self.bytes_of[token])
        return self.halves[token]

    def _split(self, token: bytes) -> tuple[int, int] | None:
        if len(token) == 1:
            return -1, -1
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best == NEVER:
                return None
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        halves = tuple(ranks.get(p, NEVER) for p in parts)
        return halves if NEVER not in halves else None

    def _meets(self, left: int, right: int) -> bool:
        """Whether the right token may follow the left."""
        ranks, bytes_of = self.ranks, self.bytes_of
        left_until = right_until = NEVER
        if self.split(left) is None or self.split(right) is None:
            return False
        while True:
            merged = ranks.get(bytes_of[left] + bytes_of[right], NEVER)
            if merged < left_until and merged <= right_until and merged != NEVER:
                return False
            single_left, single_right = len(bytes_of[left]) == 1, len(bytes_of[right]) == 1
            if single_left and single_right:
                return True
            # undo the newer merge; of two equal ones the left was made first
            if single_right or (not single_left and left > right):
                left, left_until = self.split(left)[1], left
            else:
                right, right_until = self.split(right)[0], right

    def extend(self, piece: bytes, table: list[int]) -> list[int]:
        """Fill in the last tokens of the prefixes that ``table`` lacks.

        Tables of short prefixes, which many pieces share, are remembered. As one
        token only can be last, the likeliest is tried first: the last of the prefix
        before, with one more byte.
        """
        ranks, seams, width, longest = self.ranks, self.seams, self.width, self.longest
        heads, longer, bytes_of, size = self.heads, self.longer, self.bytes_of, len(piece)
        if not table:
            for cut in HEADS:
                if cut <= size and (known := heads.get(piece[:cut])) is not None:
                    table.extend(known)
                    break
        last = table[-1] if table else -1
        for end in range(len(table) + 1, size + 1):
            guess = token = longer.get(last << 8 | piece[end - 1])  # -1: no token's number
            fits = False
            if guess is not None:
                start = end - len(bytes_of[guess])
                if start:
                    fits = seams.get(table[start - 1] * width + guess)
                    if fits is None:
                        fits = self.meets(table[start - 1], guess)
                else:
                    fits = self.split(guess) is not None
            if not fits:
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    token = ranks.get(piece[start:end])
                    if token is None or token == guess:
                        continue
                    if start:
                        fits = seams.get(table[start - 1] * width + token)
                        if fits is None:
                            fits = self.meets(table[start - 1], token)
                    else:
                        fits = self.split(token) is not None
                    if fits:
                        break
            table.append(token)
            last = token
            if end in HEADS:
                if len(heads) >= HEAD_MEMORY:
                    heads.clear()
                heads[piece[:end]] = tuple(table)
        return table

    def meets(self, left: int, right: int) -> bool:
        """Whether the right token may follow the left; remembered."""
        if len(self.seams) >= SEAM_MEMORY:
            self.seams.clear()
        fits = self.seams[left * self.width + right] = self._meets(left, right)
        return fits

    def read(self, piece: bytes, table: list[int]) -> list[int]:
        """The encoding that the table holds."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._back(table)

    def _back(self, table: list[int]) -> list[int]:
        bytes_of, ids, end = self.bytes_of, [], len(table)
        while end:
            last = table[end - 1]
            ids.append(last)
            end -= len(bytes_of[last])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._back(self.extend(piece, []))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Codec:
    """A vocabulary with its pattern, encoding whole texts.

    A run without white space, with the blank before it, is cut alike wherever
    it stands, so its ids are remembered; patterns must not look back, nor cross
    from such a run into another.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary.load(path)
        self.pattern = regex.compile(exact_spaces(pattern))
        self.words_whole = pattern == public_tokenizers.PATTERN  # a word of ASCII letters is one piece
        self.runs = regex.compile(rf" ?[^{SPACE}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+")
        self.pieces = Memo(lambda piece: tuple(self.vocabulary.encode_piece(piece.encode())), PIECE_MEMORY)
        self.known = Memo(self._encode_run, RUN_MEMORY)

    def _encode_run(self, run: str) -> tuple[int, ...]:
        if self.words_whole and run.isascii() and run[run[0] == " " :].isalpha():
            return self.pieces[run]
        pieces = self.pattern.findall(run)
        if len(pieces) == 1:
            return self.pieces[pieces[0]]
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.runs.findall(text))))

    def decode(self, ids) -> bytes:
        return self.vocabulary.decode(ids)


class Text:
    """An encoded text that can be appended to and edited.

    A piece depends on the characters from its start to one past its end, and on
    ``reach`` characters at least (the longest fixed alternative of the pattern).
    So an edit leaves the pieces alone that end before it, and after it the old
    cuts hold again from the first that the new ones hit.
    """

    def __init__(self, codec: Codec, text: str = "", reach: int = 3):
        self.codec, self.reach = codec, reach
        self.text, self.starts, self.tables = "", [], []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        read = self.codec.vocabulary.read
        bounds = [*self.starts, len(self.text)]
        return [
            i
            for a, b, table in zip(bounds, bounds[1:], self.tables)
            for i in read(self.text[a:b].encode(), table)
        ]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for the characters from ``start`` to before ``end``."""
        old, shift = self.text, len(new) - (end - start)
        bounds = [*self.starts, len(old)]
        first = bisect_left(bounds, start, 1) - 1 if self.starts else 0  # ends at the edit or after it
        while first > 0 and bounds[first - 1] + self.reach > start:
            first -= 1
        if first > 0 and bounds[first] + self.reach > start:
            first -= 1
        self.text = old[:start] + new + old[end:]
        at, resume = (self.starts[first] if self.starts else 0), len(self.starts)
        starts, tables = [], []
        while at < len(self.text):
            if at >= start + len(new):
                same = bisect_left(self.starts, at - shift)
                if same < len(self.starts) and self.starts[same] == at - shift:
                    resume = same
                    break
            stop = self.codec.pattern.match(self.text, at).end()
            starts.append(at)
            tables.append(self._table(at, stop, start, shift, end))
            at = stop
        self.starts[first:] = starts + [s + shift for s in self.starts[resume:]]
        self.tables[first:] = tables + self.tables[resume:]

    def _table(self, at: int, stop: int, start: int, shift: int, end: int) -> list[int]:
        """The table of a new piece, with the rows an old piece already has."""
        kept: list[int] = []
        if at < start:
            k = bisect_right(self.starts, at) - 1
            if k >= 0 and self.starts[k] == at:
                kept = self.tables[k][: len(self.text[at : min(start, stop)].encode())]
        return self.codec.vocabulary.extend(self.text[at:stop].encode(), list(kept))


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The codec of this worker process."""
    return LOADED.get((__name__, path, pattern), lambda: Codec(path, pattern))


def encode(df: DataFrame, path: str, column: str = "text", into: str = "ids") -> DataFrame:
    """All columns, and the ids of ``column`` in ``into``. Nothing is shuffled."""
    schema = StructType([*df.drop(into).schema.fields]).add(into, ArrayType(IntegerType()))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        ids = pa.array([own.encode(t or "") for t in batch.column(column).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.drop_columns([into]).columns, ids] if into in batch.schema.names
                                          else [*batch.columns, ids], schema.names)

    return df.mapInArrow(per_batch(one), schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256. One narrow pass.

    The digests are of the decimal ids joined by commas, and of the bytes that
    the ids decode to.
    """
    schema = StructType([df.schema[key]]).add("n_tokens", "long")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        text_of, sha = own.vocabulary.text_of, hashlib.sha256
        sizes, encoded, decoded = [], [], []
        for text in batch.column(column):
            ids = own.encode(text.as_py() or "")
            sizes.append(len(ids))
            encoded.append(sha(",".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
            decoded.append(sha(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(sizes, pa.int64()), pa.array(encoded), pa.array(decoded)], schema.names
        )

    return df.select(F.col(key), F.col(column)).mapInArrow(per_batch(one), schema)
