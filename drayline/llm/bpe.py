"""Byte-level BPE of whole texts as a streaming transducer with bounded lookahead, and its inverse.

A text is cut into pieces by the vocabulary's pattern and merged piece by piece. Pieces are read from windows of the text:
one is taken when what follows in the window can no longer change it. A piece longer than a window is merged
while it is read: merging the bytes read so far gives tokens, and those that end more than the *sufficient lookahead*
before the last byte are the tokens of every text that goes on from there, so they are emitted and forgotten.

The lookahead follows from the merge list alone. Let merging a text and a beginning of it differ first, from the left, at
a boundary that the merge r = (u, v) removed in one of them. Then v was hindered in the other, by an earlier merge whose left part is
a part of v; so the difference can lie at most ``end of that part in v + reach of that earlier merge`` before the end of
the beginning, or the length of v where no merge came before. The greatest of these sums over the merges, in order
of rank, bounds how far the end of what has been read reaches back. Memory is therefore bounded by the window and the
lookahead, whatever a piece's length; the bytes and tokens of a row itself are Arrow arrays.

Decoding looks up each token's bytes and turns them into text with an incremental UTF-8 decoder, which carries the bytes of an
unfinished character from one chunk to the next; bytes that are no UTF-8 become U+FFFD.

A NULL text is empty, an empty text has no tokens. The vocabulary's special token is recognised in texts, as its library does
unless told otherwise. Rows are independent: repeated or NULL ids stay as they are. Only doc_id and text are read.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.llm import text as texts

WINDOW = 1 << 15
DECODED = 1 << 16
CACHED_PIECES = 1 << 18
CACHED_LENGTH = 64
HELD = 1 << 20
TOGETHER = 4096
NONE = 1 << 62

#: How the vocabulary's library cuts texts into pieces; L, N and O are letters, numbers and what is neither these nor white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?L+| ?N+| ?O+|\s+(?!\S)|\s+"""
#: A piece that ends this many characters before the end of a window does not change with what follows (contractions look two ahead).
SETTLED = 3
SPACES = regex.compile(r"\s*")


def _compiled(pattern: str, unknown: str) -> regex.Pattern:
    """``unknown``: letters and numbers that are O to the library, as ranges."""
    less, more = (f"--[{unknown}]", f"||[{unknown}]") if unknown else ("", "")
    classes = {"L": rf"[\p{{L}}{less}]", "N": rf"[\p{{N}}{less}]", "O": rf"[[^\s\p{{L}}\p{{N}}]{more}]"}
    return regex.compile("".join(classes.get(c, c) if not before == "\\" else c for before, c in zip(" " + pattern, pattern)), regex.V1)


def unknown_characters() -> str:
    """Letters and numbers of this Python's Unicode version that the vocabulary's library does not know as such, as ranges of a
    character class. It is asked for all of them at once, each after a letter or digit of its kind and before a mark."""
    from tokenizers.pre_tokenizers import ByteLevel

    everything = "".join(chr(c) for c in range(256, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    found = [(before, c) for before, kind in (("a", r"\p{L}"), ("1", r"\p{N}")) for c in regex.findall(kind, everything)]
    asked = "".join(before + c + "!" for before, c in found)
    starts = {start for _, (start, _) in ByteLevel(add_prefix_space=False).pre_tokenize_str(asked)}
    unknown = sorted(ord(c) for i, (_, c) in enumerate(found) if 3 * i + 1 in starts)
    ranges: list[list[int]] = []
    for c in unknown:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 ones for themselves, the next free ones from U+0100 for the others."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text; it is read where the job is planned and travels with the tasks (1.5 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class MergeTable:
    """The merges of a vocabulary as arrays, for several pieces at once. ``word_end`` is what the vocabulary puts behind a piece's last byte."""

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str = "") -> None:
        by_byte = [c for c, _ in sorted(byte_characters().items(), key=lambda x: x[1])]
        self.byte_id = np.array([vocabulary[c] for c in by_byte])
        self.last_id = np.array([vocabulary[c + word_end] for c in by_byte])
        self.size = 1 + max(vocabulary.values())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs] or [-1], dtype=np.int64)
        self.rank_of_key = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.rank_of_key], np.array([vocabulary[a + b] for a, b in pairs] or [0], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of_key[at], NONE)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of short pieces, none of them empty, as 32-bit numbers."""
        ids, counts = self.merge(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces]))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short pieces that lie one behind the other, and how many each has: the earliest merge first, a row each."""
        ids = np.full((len(lengths), lengths.max() + 1), -1, dtype=np.int64)
        coded, last = self.byte_id[data], np.cumsum(lengths) - 1
        coded[last] = self.last_id[data[last]]
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = coded
        done = np.full(ids.shape, -1, dtype="<i4")
        rows, ranks = np.arange(len(lengths)), self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.min(axis=1)
            going = best < NONE
            if not going.all():
                done[rows[~going], : ids.shape[1]] = ids[~going]
                rows, ids, ranks, best = rows[going], ids[going], ranks[going], best[going]
                if not len(rows):
                    break
            at, row = ranks.argmin(axis=1), np.arange(len(rows))
            ids[row, at] = self.made[best]
            columns = np.arange(ids.shape[1] - 1)
            kept = columns + (columns > at[:, None])  # without the right part
            ids, ranks = np.take_along_axis(ids, kept, 1), np.take_along_axis(ranks, kept[:, :-1], 1)
            for left in (np.maximum(at - 1, 0), at):  # a row ends in a -1, so there is a right neighbour
                ranks[row, left] = self._ranks(ids[row, left], ids[row, left + 1])
        found = done >= 0
        return done[found], found.sum(axis=1)

    def merged_by_length(self, pieces: list[tuple[bytes, str]]) -> Iterator[tuple[str, bytes]]:
        """(name, ids) of pieces with their names, those of like length together."""
        by_length: dict[int, list[tuple[bytes, str]]] = {}
        for piece in pieces:
            by_length.setdefault(len(piece[0]) // 3, []).append(piece)
        for alike in by_length.values():
            for at in range(0, len(alike), TOGETHER):
                data, names = zip(*alike[at : at + TOGETHER])
                yield from zip(names, self.merged(data))


class Transducer:
    """Ids of texts, and texts of ids. ``lookahead``: bytes after a token's end from which on it cannot change any more."""

    def __init__(self, vocabulary: str, unknown: str) -> None:
        read = json.loads(vocabulary)
        character = byte_characters()
        ids: dict[str, int] = read["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(character[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [ids[c] for c, _ in sorted(character.items(), key=lambda x: x[1])]
        merges = [m if isinstance(m, list) else m.split(" ") for m in read["model"]["merges"]]
        self.made = [ids[a + b] for a, b in merges]
        pairs = [(ids[a], ids[b]) for a, b in merges]
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        self.table = MergeTable(ids, merges)
        self.lookahead = self._sufficient_lookahead(pairs)
        self.pieces, self.latin_pieces = _compiled(PATTERN, unknown), _compiled(PATTERN, "")
        self.runs = [(_compiled(f" ?{c}+", unknown), _compiled(f"{c}*", unknown)) for c in "LNO"]
        self.find_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def _sufficient_lookahead(self, pairs: list[tuple[int, int]]) -> int:
        """See the module's description. ``parts[t]``: (token, where it ends in t) of all tokens that t was made of."""
        parts = {i: [(i, 1)] for i in self.byte_id}
        reach: dict[int, int] = {}  # of the merges so far, by their left part
        for (u, v), made in zip(pairs, self.made):
            if u not in parts or v not in parts or made in parts:
                raise ValueError("every part of a merge must be a byte or made by an earlier merge, and made once")
            back = max(end + reach.get(part, 0) for part, end in parts[v])
            reach[u] = max(reach.get(u, 0), back)
            left = len(self.bytes_of[u])
            parts[made] = parts[u] + [(part, left + end) for part, end in parts[v]] + [(made, len(self.bytes_of[made]))]
        return max(reach.values(), default=0) + 1

    # --- text to ids ---------------------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """The tokens of bytes, by the earliest merge first and from the left. Neighbours that merge wait in a heap by rank and
        place; a taken token is -1."""
        ids, rank = [self.byte_id[b] for b in data], self.rank.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        waiting = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p)) is not None]
        heapify(waiting)
        while waiting:
            r, i = heappop(waiting)
            j = after[i]
            if j == len(ids) or rank((ids[i], ids[j])) != r:  # one of the two has changed since
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := rank((ids[i], ids[after[i]]))) is not None:
                    heappush(waiting, (r, i))
            if before[i] >= 0 and (r := rank((ids[before[i]], ids[i]))) is not None:
                heappush(waiting, (r, before[i]))
        return [i for i in ids if i >= 0]

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that arrives in parts, each as soon as it is stable."""
        buffer = b""
        for part in parts:
            for at in range(0, len(part), self.lookahead):
                buffer += part[at : at + self.lookahead]
                if len(buffer) > 4 * self.lookahead:
                    emitted = 0
                    for token in self.merged(buffer):
                        if emitted + len(self.bytes_of[token]) >= len(buffer) - self.lookahead:
                            break
                        yield token
                        emitted += len(self.bytes_of[token])
                    buffer = buffer[emitted:]
        yield from self.merged(buffer)

    def encode(self, several: list[str], cache: PieceCache) -> list[bytes]:
        """The ids of texts as little-endian 32-bit numbers. Pieces are held for about ``HELD`` characters at a time."""
        done: list[list[bytes]] = [[] for _ in several]
        held, characters = [], 0

        def flush() -> None:
            cache.learn({p for _, pieces in held for p in pieces})
            for i, pieces in held:
                done[i].append(b"".join(map(cache.__getitem__, pieces)))
            held.clear()

        for i, text in enumerate(several):
            for pieces, length in self._parts(text):
                held.append((i, pieces))
                characters += length
                if characters >= HELD:
                    flush()
                    characters = 0
        flush()
        return [b"".join(parts) for parts in done]

    def _parts(self, text: str) -> Iterator[tuple[list[str | bytes], int]]:
        """Pieces in order, a window at a time, and the characters they cover; ids stand in place of long pieces and special tokens."""
        at = 0
        for found in self.find_special.finditer(text):
            yield from self._ordinary_parts(text, at, found.start())
            yield [self.special[found[0]].to_bytes(4, "little")], len(found[0])
            at = found.end()
        yield from self._ordinary_parts(text, at, len(text))

    def _ordinary_parts(self, text: str, at: int, end: int) -> Iterator[tuple[list[str | bytes], int]]:
        while at < end:
            window = text[at : min(end, at + WINDOW)]
            pieces, taken = (self.latin_pieces if _is_latin(window) else self.pieces).findall(window), len(window)
            if at + taken < end:
                while pieces and taken > len(window) - SETTLED:
                    taken -= len(pieces.pop())
            if pieces:
                yield pieces, taken
            else:
                to = self._end_of_long(text, at, end)
                parts = (text[i : min(to, i + WINDOW)].encode() for i in range(at, to, WINDOW))
                yield [np.fromiter(self.stream(parts), dtype="<i4").tobytes()], WINDOW
                taken = to - at
            at += taken

    def _end_of_long(self, text: str, at: int, end: int) -> int:
        """Where the piece that begins at ``at`` ends, when that is beyond a window."""
        for start, goes_on in self.runs:
            if found := start.match(text, at, min(end, at + WINDOW)):
                return _end_of_run(goes_on, text, found.end(), end)
        to = _end_of_run(SPACES, text, at, end)
        return to if to == end else to - 1  # the last space before a word is that word's

    # --- ids to text ---------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids, a chunk at a time; ids that are not in the vocabulary have no text."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        ids = ids[(ids >= 0) & (ids < len(self.bytes_of))]
        for at in range(0, len(ids), DECODED):
            yield decoder.decode(b"".join(map(self.bytes_of.__getitem__, ids[at : at + DECODED].tolist())))
        yield decoder.decode(b"", True)


def _is_latin(text: str) -> bool:
    """Whether no character is beyond U+00FF; the classes of these do not change between versions, and are found faster."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _end_of_run(goes_on: regex.Pattern, text: str, at: int, end: int) -> int:
    while at < end:
        to = goes_on.match(text, at, min(end, at + WINDOW)).end()
        if to < min(end, at + WINDOW):
            return to
        at = to
    return end


class PieceCache(dict):
    """Ids of pieces, forgotten when there are too many; it lasts for a task."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def learn(self, pieces: set[str | bytes]) -> None:
        """Take in the short pieces that are new."""
        new = [p for p in pieces.difference(self) if len(p) <= CACHED_LENGTH and isinstance(p, str)]
        if len(self) + len(new) > CACHED_PIECES:
            self.clear()
            new = [p for p in pieces if len(p) <= CACHED_LENGTH and isinstance(p, str)]
        self.update(self.transducer.table.merged_by_length([(p.encode(), p) for p in new]))

    def __missing__(self, piece: str | bytes) -> bytes:
        """A long piece, which is not kept, or ids."""
        if isinstance(piece, bytes):
            return piece
        return np.fromiter(self.transducer.stream([piece.encode()]), dtype="<i4").tobytes()


@lru_cache(1)
def transducer(vocabulary: str, unknown: str) -> Transducer:
    """One of the current vocabulary is kept by a Python worker; its size is that of the vocabulary."""
    return Transducer(vocabulary, unknown)


def _encode(sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(*sent.value)
        cache = PieceCache(machine)
        for part in texts.each_chunk(batches):
            ids = machine.encode([t or "" for t in part.column("text").to_pylist()], cache)
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            arrays = [part.column("doc_id"), texts.lists(np.frombuffer(b"".join(ids), dtype="<i4"), bounds, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids"])

    return run


def _decode(sent, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(*sent.value)
        for batch in batches:
            column = batch.column(at)
            ids, first = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            decoded = ["".join(machine.decode(ids[a:b])) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, type=pa.string())], [*batch.schema.names, "text"])

    return run


def _send(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast((read_vocabulary(path or default_vocabulary()), unknown_characters()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(_send(docs.sparkSession, path)), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``text``, the text of ``ids`` (integers, none NULL; a NULL list is empty). The frame must have no ``text`` of its own."""
    if "text" in (c.lower() for c in tokens.columns):
        raise ValueError("the tokens have a column text already")
    schema = T.StructType([*tokens.schema.fields, T.StructField("text", T.StringType())])
    return tokens.mapInArrow(_decode(_send(tokens.sparkSession, path), tokens.columns.index("ids")), schema)


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and hashes of ids and decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
