"""Directly addressable codes: token ids in chunk levels with continuation bitmaps and rank directories.

A segment holds the ids of consecutive documents. Level 0 has the low bits of every id; an id that needs more has its bit set in the
level's continuation bitmap, and its next chunk stands in level 1 at the rank of that bit. The rank directory has the number of set bits
before each 512-bit block. So the id at any place is found from one value, one bit and one rank a level, without decoding a block.

Layout: "DAC1", levels (u1), widths in bits (u1 each), then for each level its length (u8), its values (u1, u2 or u4, little-endian),
and, but for the last, the bitmap (little-endian bits, padded to 64 bytes) and the directory (u4 for each block).
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import SPACE, bytes_of, frugal, new_path, shuffle_partitions, small_batches, spread, table_of, text_batches, whole_text

WIDTHS = (8, 8, 16)
#: Bytes of a batch of texts to encode: few enough that its distinct pieces fit what a worker remembers, or each batch would find nothing remembered.
BYTES = 2 << 20
SEGMENT_TOKENS = 1 << 20
BLOCK = 512
LETTERS = table_of((0x41, 0x5A), (0x61, 0x7A))
MARKS = table_of((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _dtype(width: int) -> str:
    return "<u1" if width <= 8 else "<u2" if width <= 16 else "<u4"


def packed(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The ids (below 2 ** sum(widths)) as one segment."""
    out, rest = [b"DAC1", struct.pack("<B", len(widths)), bytes(widths)], np.asarray(ids, np.uint64)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id has more bits than the levels")
    for k, width in enumerate(widths):
        out.append(struct.pack("<Q", len(rest)))
        out.append((rest & np.uint64(2**width - 1)).astype(_dtype(width)).tobytes())
        rest = rest >> np.uint64(width)
        if k + 1 < len(widths):
            more = rest > 0
            bits = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
            bits[: len(more)] = more
            ones = bits.reshape(-1, BLOCK).sum(axis=1)
            out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            rest = rest[more]
    return b"".join(out)


def _levels(blob: bytes) -> list[tuple]:
    if blob[:4] != b"DAC1":
        raise ValueError("not a DAC segment")
    widths, at, out = blob[5 : 5 + blob[4]], 5 + blob[4], []
    for k, width in enumerate(widths):
        (n,) = struct.unpack_from("<Q", blob, at)
        at += 8
        values = np.frombuffer(blob, _dtype(width), n, at)
        at += values.nbytes
        bits = ranks = None
        if k + 1 < len(widths):
            blocks = -(-n // BLOCK)
            bits = np.frombuffer(blob, np.uint8, blocks * BLOCK // 8, at)
            at += bits.nbytes
            ranks = np.frombuffer(blob, "<u4", blocks, at)
            at += ranks.nbytes
        out.append((width, values, bits, ranks))
    return out


def unpacked(blob: bytes) -> np.ndarray:
    """All ids of a segment."""
    levels = _levels(blob)
    out, places, shift = levels[0][1].astype(np.uint32), np.arange(len(levels[0][1])), 0
    for (width, values, bits, _), deeper in zip(levels, levels[1:], strict=False):
        shift += width
        places = places[np.unpackbits(bits, count=len(values), bitorder="little").astype(bool)]
        if not len(places):
            break
        out[places] |= deeper[1].astype(np.uint32) << np.uint32(shift)
    return out


def at(blob: bytes, places: np.ndarray) -> np.ndarray:
    """The ids at the given places of a segment, read through the rank directories."""
    places = np.asarray(places, np.int64)
    out, live, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
    for width, values, bits, ranks in _levels(blob):
        out[live] |= values[places].astype(np.uint32) << np.uint32(shift)
        shift += width
        if bits is None:
            break
        more = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
        live, places = live[more], places[more]
        if not len(live):
            break
        block, inside = places // BLOCK, places % BLOCK
        held = np.unpackbits(bits.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
        places = ranks[block].astype(np.int64) + (held * (np.arange(BLOCK) < inside[:, None])).sum(axis=1, dtype=np.int64)
    return out


# --------------------------------------------------------------------------- encoding


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    bytes_in = np.zeros(t.get_vocab_size(), np.int64)
    for token, i in t.get_vocab().items():
        bytes_in[i] = len(token)  # byte-level: a character for each byte
    return t, bytes_in, tuple(x.content.encode() for x in t.get_added_tokens_decoder().values())


class Pieces:
    """Ids of pieces of text, kept for up to most pieces and most_bytes of them in a worker."""

    def __init__(self, tokenizer: str, most: int = 300_000, most_bytes: int = 12 << 20):
        self.tokenizer, self.most, self.most_bytes = tokenizer, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.first, self.count, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.used = np.zeros(0, np.int32)

    def of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All known ids joined, and the first place and number of ids of each of the given distinct pieces."""
        if len(self.index) > self.most or self.bytes > self.most_bytes:
            self._keep_repeated()
        index = self.index
        new = [w for w in pieces if w not in index]
        if new:
            ids, counts = self._encoded(new)
            index.update(zip(new, range(len(self.first), len(self.first) + len(new)), strict=True))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(counts) - counts])
            self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, counts])
            self.bytes += sum(map(len, new))
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
        at = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        self.used[at] += 1
        return self.flat, self.first[at], self.count[at]

    def _keep_repeated(self) -> None:
        """Keeps what more than one batch had, or nothing where that is still too much."""
        stay = [w for w, i in self.index.items() if self.used[i] > 1]
        at = np.fromiter((self.index[w] for w in stay), np.int64, len(stay))
        flat, first, count = self.flat, self.first[at], self.count[at]
        self.clear()
        size = sum(map(len, stay))
        if len(stay) <= self.most // 2 and size <= self.most_bytes // 2:
            group, place = spread(count)
            self.index, self.bytes = {w: i for i, w in enumerate(stay)}, size
            self.flat, self.first, self.count, self.used = flat[first[group] + place], np.cumsum(count) - count, count, np.zeros(len(stay), np.int32)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, joined, and how many each has.

        Pieces of one run of white space before other characters are encoded side by side and parted by their lengths in bytes; the others alone.
        """
        t, bytes_in, added = _tokenizer(self.tokenizer)
        n = len(pieces)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ends = np.cumsum(size)
        plain = SPACE[data[ends - size]] & ~SPACE[data[ends - 1]]  # begins with white space and ends with another character
        inner = SPACE[data[1:]] & ~SPACE[data[:-1]]  # white space behind another character
        inner[ends[:-1] - 1] = False
        plain[np.searchsorted(ends, np.flatnonzero(inner), side="right")] = False
        plain &= ~odd_documents(data, np.concatenate([[0], ends]), added)
        side, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        out, counts = [], np.zeros(n, np.int64)
        for i in range(0, len(alone), 1000):
            some = alone[i : i + 1000]
            for k, e in zip(some.tolist(), t.encode_batch([pieces[j].decode("utf-8") for j in some.tolist()], add_special_tokens=False), strict=True):
                out.append(np.array(e.ids, np.uint32))
                counts[k] = len(e.ids)
        for i in range(0, len(side), 4000):
            some = side[i : i + 4000]
            joined = b"".join(pieces[j] for j in some.tolist()).decode("utf-8")
            got = np.array(t.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            stops, reached = np.cumsum(size[some]), np.cumsum(bytes_in[got])
            stop = np.searchsorted(reached, stops) + 1
            if not np.array_equal(reached[stop - 1], stops):
                raise ValueError("a token reaches over white space")
            out.append(got)
            counts[some] = np.diff(np.concatenate([[0], stop]))
        of = np.concatenate([alone, side])
        ids = np.concatenate(out)
        begins = np.zeros(n, np.int64)
        begins[of] = np.cumsum(counts[of]) - counts[of]
        group, place = spread(counts)
        return ids[begins[group] + place], counts


_KEPT: dict[str, Pieces] = {}


def odd_documents(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> np.ndarray:
    """Which documents hold white space other than \\x20 and \\x09-\\x0D, or the text of an added token, which the library takes whole; only the others may be cut at white space."""
    at_ = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    p = np.flatnonzero(data == 0xC2)
    at_.append(p[np.isin(pad[p + 1], (0x85, 0xA0))])
    p = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    a, b, c = pad[p], pad[p + 1], pad[p + 2]
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    at_.append(p[(a == 0xE1) & np.isin(b, (0x9A, 0xA0)) | general | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)])
    raw = data.tobytes() if added else b""
    for word in added:
        at_.append(np.array([m.start() for m in re.finditer(re.escape(word), raw)], np.int64))
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate(at_), side="right") - 1] = True
    return out


def encoded(column: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch of texts, joined, and the number of ids of each.

    No token of byte-level BPE reaches from a character that is not white space into following white space, and none from a letter into a following mark. So texts are
    cut before each run of white space and between an ASCII letter and an ASCII mark, each distinct piece is encoded once, and the pieces' ids are gathered.
    """
    data, offsets = bytes_of(column)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    space = SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[1:] |= LETTERS[data[:-1]] & MARKS[data[1:]]
    begins = offsets[:-1][np.diff(offsets) > 0]
    odd = odd_documents(data, offsets, _tokenizer(tokenizer)[2])
    if odd.any():
        cut[np.repeat(odd, np.diff(offsets))] = False
    cut[begins] = True
    starts = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    codes = pieces.indices.to_numpy(zero_copy_only=False)
    flat, first, lengths = _KEPT.setdefault(tokenizer, Pieces(tokenizer)).of(pieces.dictionary.to_pylist())
    group, place = spread(lengths[codes])
    joined = flat[first[codes][group] + place]
    before = np.concatenate([[0], np.cumsum(lengths[codes])])
    return joined, np.diff(before[np.searchsorted(starts, offsets)])


def _writer(tokenizer: str, end_id: int, widths: tuple[int, ...], limit: int):
    def run(batches):
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for b in text_batches(batches, BYTES):
            ids, counts = encoded(b.column("text"), tokenizer)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            key = (ends - counts) // limit
            for a in np.flatnonzero(np.append(True, key[1:] != key[:-1])):
                z = int(np.searchsorted(key, key[a], side="right"))
                x, y = int(ends[a] - counts[a]), int(ends[z - 1])
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int32()),
                        "seq": pa.array([seq], pa.int32()),
                        "part_start": pa.array([start], pa.int64()),
                        "n_tokens": pa.array([y - x], pa.int64()),
                        "doc_ids": pa.array([b.column("doc_id").slice(a, z - a).to_pylist()], pa.list_(pa.int64())),
                        "doc_tokens": pa.array([counts[a:z]], pa.list_(pa.int64())),
                        "codes": pa.array([packed(ids[x:y], widths)], pa.binary()),
                    }
                )
                seq, start = seq + 1, start + y - x
        _KEPT.clear()  # an idle worker remembers nothing: other tasks have few of the same pieces

    return run


FILE_SCHEMA = "part int, seq int, part_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, widths: tuple[int, ...] = WIDTHS, partitions: int | None = None) -> None:
    """Encodes every whole text and writes DAC segments to path, in ascending order of doc_id over files and segments.

    A null text has the end id alone; a null doc_id comes first; rows that share a doc_id are ordered by text and all written. Ranges of doc_id
    are dealt to tasks, so a hot source or large group of copies needs no care. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    d = d.repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    d.mapInArrow(frugal(_writer(tokenizer, end_id, widths, SEGMENT_TOKENS)), FILE_SCHEMA).write.parquet(path)


def first_places(spark: SparkSession, path: str) -> dict[int, int]:
    """The place of the first id of each writing task; as many entries as tasks."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    out, total = {}, 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        out[part] = total
        total += n
    return out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files."""
    bases = first_places(spark, path)

    def run(batches):
        for b in batches:
            for part, start, n, ids, lengths, blob in zip(*(b.column(c).to_pylist() for c in ("part", "part_start", "n_tokens", "doc_ids", "doc_tokens", "codes")), strict=True):
                raw = memoryview(np.ascontiguousarray(unpacked(blob), "<u4").view(np.uint8))
                ends = np.cumsum(np.array(lengths, np.int64))
                if len(raw) != 4 * n or ends[-1] != n:
                    raise ValueError("a segment's ids are not as many as its header says")
                begins = ends - lengths
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "start": pa.array(bases[part] + start + begins, pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    }
                )

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    return files.mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The id at each place (column place: long) of the whole sequence, by random access within segments; places beyond the end have none.

    Places are found in the segments' headers first, so that each wanted segment is read once, with all its places.
    """
    bases = first_places(spark, path)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv]) if bases else F.create_map(F.lit(0), F.lit(0))
    headers = files.select("part", "seq", (base[F.col("part")] + F.col("part_start")).alias("a"), "n_tokens")
    cell = lambda x: F.floor(x / F.lit(SEGMENT_TOKENS))
    spans = headers.withColumn("cell", F.explode(F.sequence(cell(F.col("a")), cell(F.col("a") + F.col("n_tokens") - 1))))
    own = places.select(F.col("place").cast("long").alias("place"))
    wanted = own.distinct().withColumn("cell", cell(F.col("place")))
    hit = wanted.join(spans, (wanted["cell"] == spans["cell"]) & (wanted["place"] >= spans["a"]) & (wanted["place"] < spans["a"] + spans["n_tokens"]))
    # as many places a segment as it has tokens, at most
    lists = hit.groupBy("part", "seq", "a").agg(F.collect_list("place").alias("places"))

    def run(batches):
        for b in batches:
            for a, wanted, blob in zip(b.column("a").to_pylist(), b.column("places").to_pylist(), b.column("codes").to_pylist(), strict=True):
                x = np.array(wanted, np.int64)
                yield pa.RecordBatch.from_pydict({"place": pa.array(x), "id": pa.array(at(blob, x - a).astype(np.int64))})

    found = files.select("part", "seq", "codes").join(lists, ["part", "seq"]).select("a", "places", "codes").mapInArrow(run, "place long, id long")
    return own.join(found, "place")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the token files and reads them back: one row per document."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)
