"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary, by forced boundaries.

Merging never crosses a place between two bytes that stand side by side in no vocabulary token: whatever is merged is itself a
token. Such a place is a certain cut. Texts are cut there, the fragments (mostly words) are encoded independently, each distinct
one once per worker, and the ids are concatenated. Cuts are taken only where the pattern that splits text before the merges
agrees as well: not after white space (whose last character may belong to what follows), not before an apostrophe (which could
begin a contraction) and not inside a character. The result is exactly that of encoding the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridloom.session import ship

#: Where the vocabulary files are; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK = 1 << 18  # bytes cut at a time
KEEP = 300_000  # distinct fragments kept by a worker
KEEP_IDS = 4_000_000


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256: whether text may be cut between these two bytes."""
    cut = np.ones((256, 256), dtype=bool)
    for token in ranks:
        b = np.frombuffer(token, dtype=np.uint8)
        cut[b[:-1], b[1:]] = False
    cut[:0x21] = False  # white space and controls before
    cut[0x7F] = False
    # last bytes of the white space characters outside of ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000)
    cut[[0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    cut[:, 0x27] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    cut[0xC0:] = False
    return cut


class _Fragments(dict):
    """Fragment -> its number; encodes what it has not met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.lengths = np.zeros(1024, dtype=np.int64)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype=np.int32)
        self.used = 0

    def __missing__(self, fragment: bytes) -> int:
        ids = self.encode(fragment.decode("utf-8", "replace"))
        n, k = len(self), len(ids)
        if n == len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + k > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + k] = ids
        self.lengths[n], self.starts[n] = k, self.used
        self.used += k
        self[fragment] = n
        return n


_MASK = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)


class _Short:
    """Numbers of fragments of up to 15 bytes, looked up all at once.

    A direct-mapped table that holds whole fragments (15 bytes and the length in two words), so that a hit is certain; a fragment
    that lost its place to another is looked up in the dictionary.
    """

    BITS = 19
    LONGEST = 15

    def __init__(self):
        self.words = np.zeros((2, 1 << self.BITS), dtype=np.uint64)
        self.numbers = np.zeros(1 << self.BITS, dtype=np.int64)

    @staticmethod
    def words_of(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw must be followed by 16 more bytes."""
        window = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        low = window[starts] & _MASK[np.minimum(lengths, 8)]
        high = window[starts + 8] & _MASK[np.maximum(lengths, 8) - 8] | (lengths.astype(np.uint64) << np.uint64(56))
        return low, high

    def places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.BITS)


class ForcedBoundaryEncoder:
    """Encodes columns of texts; one per worker process and vocabulary."""

    _kept: dict[str, ForcedBoundaryEncoder] = {}

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.plain = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = certain_cuts(ranks).reshape(-1)
        self._forget()

    def _forget(self) -> None:
        self.fragments, self.short = _Fragments(self.plain), _Short()

    def _numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each fragment raw[start:end]."""
        lengths = ends - starts
        number = np.full(len(starts), -1, dtype=np.int64)
        small = np.flatnonzero(lengths <= _Short.LONGEST)
        t = self.short
        low, high = t.words_of(raw + bytes(16), starts[small], lengths[small])
        place = t.places(low, high)
        hit = (t.words[0, place] == low) & (t.words[1, place] == high)
        number[small[hit]] = t.numbers[place[hit]]
        rest = np.flatnonzero(number < 0)
        if len(rest):
            pairs = zip(starts[rest].tolist(), ends[rest].tolist())
            number[rest] = np.fromiter(map(self.fragments.__getitem__, [raw[i:j] for i, j in pairs]), dtype=np.int64, count=len(rest))
            miss = ~hit
            at = place[miss]
            t.numbers[at] = -1
            t.words[:, at] = 0
            # of several that want a place, the last one gets it whole
            _, last = np.unique(at[::-1], return_index=True)
            chosen = len(at) - 1 - last
            t.words[0, at[chosen]], t.words[1, at[chosen]] = low[miss][chosen], high[miss][chosen]
            t.numbers[at[chosen]] = number[small[miss]][chosen]
        return number

    @classmethod
    def of(cls, vocabulary: str) -> ForcedBoundaryEncoder:
        if vocabulary not in cls._kept:
            cls._kept[vocabulary] = cls(vocabulary)
        return cls._kept[vocabulary]

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and fragment numbers of data's fragments, chunk by chunk. bounds: sorted places that are cut in any case."""
        at, end, size = 0, len(data), CHUNK
        while at < end:
            stop = min(at + size, end)
            part = data[at:stop]
            cut = np.zeros(stop - at, dtype=bool)
            cut[0] = True
            if len(part) > 1:
                cut[1:] = self.cut[(part[:-1].astype(np.uint16) << 8) | part[1:]]
            low, high = np.searchsorted(bounds, [at, stop])
            cut[bounds[low:high] - at] = True
            starts = np.flatnonzero(cut)
            if stop < end:
                if len(starts) == 1:  # no cut in this chunk: look further
                    size *= 2
                    continue
                stop, starts = at + int(starts[-1]), starts[:-1]
            size = CHUNK
            raw = data[at:stop].tobytes()
            if len(self.fragments) > KEEP or self.fragments.used > KEEP_IDS:
                self._forget()
            yield starts + at, self._numbers(raw, starts, np.append(starts[1:], stop - at))
            at = stop

    def _cut_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if texts.buffers()[2] is None or len(texts) == 0 or offsets[0] == offsets[-1]:
            return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
        return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]

    def encode(self, texts: pa.Array, only_count: bool = False) -> pa.Array:
        """Lists of ids (int32), or their lengths (int64); a null or empty text has an empty list."""
        data, offsets = self._cut_up(texts)
        starts, lengths, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for begin, number in self._pieces(data, np.unique(offsets[offsets < len(data)])):
            f = self.fragments
            n = f.lengths[number]
            starts.append(begin)
            lengths.append(n)
            if not only_count:
                first = np.repeat(f.starts[number] - (np.cumsum(n) - n), n)
                ids.append(f.ids[first + np.arange(len(first))])
        total = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        at = total[np.searchsorted(np.concatenate(starts), offsets)]
        if only_count:
            return pa.array(np.diff(at), type=pa.int64())
        return pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(np.concatenate(ids), type=pa.int32()))


def _encoded(df: DataFrame, keep: list[str], text: str, name: str, vocabulary: str, only_count: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ForcedBoundaryEncoder.of(vocabulary)
        for batch in batches:
            out = encoder.encode(batch.column(len(keep)), only_count)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], out], names=[*keep, name])

    ship(df.sparkSession)
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{name}` {'bigint' if only_count else 'array<int>'}"])
    return df.select(*keep, text).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep and ids (array of int), row by row and without a shuffle: the ids of the whole text, without special tokens.

    Empty and null texts give an empty list. Texts of any length are cut up in chunks. Repeated rows come out as often as they
    go in, an empty table gives an empty one, and other columns are not read.
    """
    return _encoded(df, keep, text, "ids", vocabulary, False)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep and n_tokens: the length of each text's list of ids (0 for null and empty texts)."""
    return _encoded(df, keep, text, "n_tokens", vocabulary, True)
