"""Byte-level BPE with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_of

#: Chunks end where the low bits of a hash of the last 8 bytes are 0: one place in 1,024 on average.
CHUNK_BITS = 10
#: Bytes that a chunk holds at least.
LEAST_CHUNK = 128
#: Bytes of chunks that a worker remembers before it forgets all.
CACHE_BYTES = 24_000_000
#: The splitting pattern of byte-level tokenizer files with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space after a visible ASCII character always ends one piece and starts another, whatever stands around the two.
CLEAN = re.compile(rb"[\x21-\x7e](?= )")
#: Characters whose classes are the same in every Unicode version of the two encoders.
PLAIN = re.compile("[^\x00-ɏ‐-‧€]")


class Vocabulary:
    """Encodes and decodes by one byte-level tokenizer file.

    Plain text goes to a fast encoder over the same merges, if the file's ids are the ranks of its merges; all other text,
    and every text if they are not, goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab, added = said["model"]["vocab"], {x["content"]: x["id"] for x in said["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.fast = None
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in said["model"]["merges"]]
        pre = said.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not said.get("normalizer")
        if plain and all(x["special"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in said["added_tokens"]) and all(vocab[m] == 256 + i for i, m in enumerate(merges)):
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocab.values()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
            self.special = set(added)

    @cached_property
    def slow(self):
        """The library's own tokenizer, without truncation and padding."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids as the tokenizers library gives them without added special tokens."""
        if self.fast is not None and (text.isascii() or not PLAIN.search(text)):
            try:
                return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype(np.uint32, copy=False)
            except ValueError:  # its splitting pattern gives up on very long runs of white space; the library doesn't
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; ill-formed bytes are replaced as the library does."""
        raw = b"".join([self.bytes[i] for i in ids.tolist()])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def vocabulary(path: str) -> Vocabulary:
    return held(("vocabulary", path), lambda: Vocabulary(path))


def chunk_ends(data: bytes) -> list[int]:
    """Where content-defined chunks end: after 8 bytes whose hash has its top bits 0, moved on to the next character, and LEAST_CHUNK bytes on at least."""
    if len(data) < 8:
        return [len(data)]
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    at = np.flatnonzero((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHUNK_BITS) == 0) + 8
    ends, last = [], 0
    for end in at.tolist():
        if end < last + LEAST_CHUNK:
            continue
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end < len(data):
            ends.append(end)
            last = end
    return [*ends, len(data)]


class Chunk:
    """A chunk's ids when it is encoded alone, where each of them ends, and the clean places in it."""

    __slots__ = ("ids", "ends", "clean")

    def __init__(self, data: bytes, vocabulary: Vocabulary):
        self.ids = vocabulary.encode(data.decode())
        self.ends = np.cumsum(vocabulary.lengths[self.ids])
        self.clean = [m.end() for m in CLEAN.finditer(data)]

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids of the bytes from start to stop, both of which are ends of ids."""
        a, b = np.searchsorted(self.ends, [start, stop], "right")
        return self.ids[a:b]


class ChunkEncoder:
    """Encodes documents chunk by chunk; a chunk that has been seen in any document is not encoded again.

    Where two chunks meet, their ids are wrong in general. The join is repaired by encoding anew what lies between two clean
    places on either side of it: the ids up to the next clean place must be those that the left chunk has there, and the ids
    from the one before the last those of the right chunk. While they are not, or a side has no such places left, the window
    grows, over whole chunks if need be.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cache, self.held = vocabulary, {}, 0
        self.reused = self.new = 0

    def own(self, data: bytes) -> Chunk:
        found = self.cache.get(data)
        if found is not None:
            self.reused += 1
            return found
        self.new += 1
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        found = self.cache[data] = Chunk(data, self.vocabulary)
        self.held += 6 * len(data) + 400
        return found

    def join(self, data: bytes, begin: int, left: Chunk, start: int, middle: int, right: Chunk) -> tuple[int, int, np.ndarray] | None:
        """(from, to, ids) of a window over the join on whose ends its neighbours agree; None if there is none in these two.

        left begins at `begin`, and its ids up to `start` are out already; right begins at `middle`.
        """
        places = [start - begin, *(c for c in left.clean if c > start - begin)]
        wide = 1
        while True:
            a = max(0, len(places) - 1 - wide)
            if wide >= len(right.clean):
                return None
            low, high = places[a], right.clean[wide]
            ids = self.vocabulary.encode(data[begin + low : middle + high].decode())
            ends = np.cumsum(self.vocabulary.lengths[ids]) + begin + low
            fine = True
            if a:  # from the start on, nothing of the left chunk is used
                next_place = places[a + 1] if a + 1 < len(places) else low
                fine = np.array_equal(ids[: np.searchsorted(ends, begin + next_place, "right")], left.between(low, next_place))
            before = right.clean[wide - 1]
            fine = fine and np.array_equal(ids[np.searchsorted(ends, middle + before, "right") :], right.between(before, high))
            if fine:
                return begin + low, middle + high, ids
            wide *= 2

    def encode(self, text: str) -> np.ndarray:
        data = text.encode()
        cuts = chunk_ends(data)
        if len(cuts) == 1:
            return self.vocabulary.encode(text)
        parts, begin, start = [], 0, 0
        left, middle = self.own(data[: cuts[0]]), cuts[0]
        for end in cuts[1:]:
            right = self.own(data[middle:end])
            if found := self.join(data, begin, left, start, middle, right):
                low, high, ids = found
                parts += [left.between(start - begin, low - begin), ids]
                begin, left, start = middle, right, high
            middle = end
        if begin + int(left.ends[-1]) == len(data):
            parts.append(left.between(start - begin, len(data) - begin))
        else:  # the last chunks joined no other: they are encoded with what comes before, back to a clean place
            low = max([start, *(begin + c for c in left.clean)])
            parts += [left.between(start - begin, low - begin), self.vocabulary.encode(data[low:].decode())]
        return np.concatenate(parts)


def chunk_encoder(path: str) -> ChunkEncoder:
    return held(("chunks", path), lambda: ChunkEncoder(Vocabulary(path)))


def encoded(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode each whole text and decode it again, in one pass without a shuffle.

    Returns id, the columns named in keep, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded text in UTF-8) and, if with_ids, ids as an array. Null text: empty, so no ids. Rows that
    are equal stay separate; an empty table gives no rows; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, text_of(text_col).alias("_text"))
    extra = ", ids array<int>" if with_ids else ""
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        for batch in batches:
            counts, hashes, back, lists = [], [], [], []
            for text in batch.column(len(batch.schema) - 1):
                ids = encoder.encode(text.as_py())
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                back.append(hashlib.sha256(encoder.vocabulary.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
