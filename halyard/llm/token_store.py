"""Token-id output: Parquet list columns that allow selective reads.

Texts are dealt by ranges of their id, so files and the rows in them ascend by
id.  A row holds the ids of one text as ``list<int>`` and its place: the file's
part number and the tokens before it in that part.  Token ids are dictionary
encoded, the sorted id and place columns delta encoded (Parquet's second data
page format), and row group and page sizes are set, so the page index lets a
reader fetch the tokens or the metadata of a few texts alone.

The tokenizer starts a new piece at a blank or line break that has no white space
on either side, so a text's ids are those of its pieces, each with the
blank or line break before it, put together; likewise a comma or full stop at a
piece's end, after a letter, is a piece of its own.  Arrow finds the distinct pieces of
a few megabytes of text at once; those seen before come from a table of about
``CACHE_PIECES`` entries a worker, which starts anew when full, and new ones go to the
tokenizer many to a string.  Texts with one of the tokenizer's own added tokens are
encoded whole.

Defined cases: a null or empty text has the end id only; repeated ids and rows
stay, ordered by content; extra columns are kept as metadata; a column named
like a result column is replaced.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import new_path, unclashed
from ._text import Slice, byte_class, slices

CACHE_PIECES, JOINED = 900_000, 1000
END_ID = 0
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 128 << 10

_TAILS, _BREAKS = frozenset(",."), frozenset(" \n")
_SPACE, _LINE = 0x20, 0x0A
#: White space in ASCII, and the first bytes of all other white space.
_BLANKS, _WIDE_FIRST = byte_class((0x09, 0x0D), (0x1C, 0x20)), byte_class((0xC2, 0xC2), (0xE1, 0xE3))
#: That white space's bytes.
_WIDE = [(0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, 0x80), (0xE2, 0x80, range(0x80, 0x8B)), (0xE2, 0x80, range(0xA8, 0xAA)), (0xE2, 0x80, 0xAF), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)]
_encoders: dict[str, Encoder] = {}


class Numbers(dict):
    """Numbers of pieces; an unknown one gets the next number and waits to be encoded."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        if piece[-1:] in _TAILS and piece[-2:-1].isalpha() and piece[-2] < "\u0250":
            n = self[piece] = self.owner.add_pair(self[piece[:-1]], self[piece[-1]])
        else:
            n = self[piece] = self.owner.add(piece)
        return n


def white_space(data: np.ndarray) -> np.ndarray:
    """The bytes of white space, whatever its script."""
    blank = _BLANKS[data]
    at = np.flatnonzero(_WIDE_FIRST[data])
    if len(at):
        first, second, third = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
        for a, b, c in _WIDE:
            same = (first == a) & (second == b)
            if isinstance(c, range):
                same &= (third >= c.start) & (third < c.stop)
            elif c is not None:
                same &= third == c
            for k in range(2 if c is None else 3):
                blank[at[same] + k] = True
    return blank


class Encoder:
    """Token ids of texts; the table of known pieces lives as long as the worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte is one character of a token's name
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.width[i] = len(name)
        self.reset()

    def reset(self) -> None:
        self.numbers = Numbers(self)
        self.fresh: list[str] = []
        self.fresh_at: list[int] = []
        self.joined: list[bool] = []
        self.pairs: list[tuple[int, int, int]] = []
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.count = 0

    def add(self, piece: str, whole: bool = False) -> int:
        """A new piece; one that is a whole text or has its white space alone or at its end isn't joined with others."""
        self.fresh.append(piece)
        self.joined.append(not whole and piece[:1] in _BREAKS and not piece[-1:].isspace())
        self.fresh_at.append(self.count)
        self.count += 1
        return self.count - 1

    def add_pair(self, left: int, right: int) -> int:
        self.pairs.append((self.count, left, right))
        self.count += 1
        return self.count - 1

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered pieces in a row, and each piece's number of ids."""
        size = self.size[numbers]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.begin[numbers] - before, size) + np.arange(size.sum())], size

    def _place(self, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.begin[numbers] = len(self.ids) + np.cumsum(size) - size
        self.size[numbers] = size
        self.ids = np.concatenate([self.ids, ids])

    def _encode_fresh(self) -> None:
        at, join = np.array(self.fresh_at), np.array(self.joined)
        if join.any():
            some = list(compress(self.fresh, self.joined))
            # strings of a thousand pieces: longer ones cost the tokenizer more a piece
            texts = ["".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)]
            got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in got), np.int32)
            cut = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in some]))
            self._place(at[join], ids, np.diff(np.r_[-1, cut]))
        if not join.all():
            got = [x.ids for x in self.tokenizer.encode_batch_fast([p for p, ok in zip(self.fresh, self.joined, strict=True) if not ok], add_special_tokens=False)]
            self._place(at[~join], np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got)))

    def _flush(self) -> None:
        more = np.zeros(self.count - len(self.begin), np.int64)
        self.begin, self.size = np.concatenate([self.begin, more]), np.concatenate([self.size, more])
        if self.fresh:
            self._encode_fresh()
        if self.pairs:
            pairs = np.array(self.pairs)
            ids, size = self._gather(pairs[:, 1:].ravel())
            self._place(pairs[:, 0], ids, size[::2] + size[1::2])
        self.fresh, self.fresh_at, self.joined, self.pairs = [], [], [], []

    def _numbered(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the texts in a row, and each text's number of them."""
        data, offsets = part.data, part.offsets
        solid = ~white_space(data)
        # a piece begins at a text, and at a blank or line break that stands alone
        starts = (data == _SPACE) | (data == _LINE)
        starts[1:] &= solid[:-1]
        starts[:-1] &= solid[1:]
        starts[-1:] = False
        starts[offsets[1:][offsets[1:] > 0] - 1] = False
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(starts)
        raw = data.tobytes()
        pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(raw))
        count = np.diff(np.searchsorted(begin, offsets))
        whole = np.zeros(len(part), bool)
        for t in map(str.encode, self.added):
            at = raw.find(t)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(t, at + 1)
        if whole.any():
            pieces = pieces.filter(pa.array(np.repeat(~whole, count)))
            count[whole] = 0
        coded = pieces.dictionary_encode()
        known = np.fromiter(map(self.numbers.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        flat = known[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
        if whole.any():
            own = np.flatnonzero(whole)
            flat = np.insert(flat, np.cumsum(count)[own], [self.add(raw[offsets[i] : offsets[i + 1]].decode(), True) for i in own.tolist()])
            count[own] = 1
        return flat, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids."""
        if self.count > CACHE_PIECES:
            self.reset()
        got = [self._numbered(part) for part in slices(texts, 8 << 20)]
        self._flush()
        flat = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.int64)
        ids, size = self._gather(flat)
        total = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        cut = np.r_[0, np.cumsum(np.concatenate([x for _, x in got]))] if got else np.zeros(1, np.int64)
        return ids, total[cut[1:]] - total[cut[:-1]]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text."""
    size = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    edge = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1, batch.num_rows]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _encode(path: str, end_id: int):
    """Rows (content, text, metadata...) of one part in order, to (part, before, tokens, metadata...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, to = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            for rows in _parts(batch, 1):
                ids, size = to.encode(rows.column(1))
                bounds = np.r_[0, np.cumsum(size)]
                out = np.insert(ids, bounds[1:], end_id)
                size = size + 1
                bounds = np.r_[0, np.cumsum(size)]
                tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(before + bounds[:-1]), pa.array(size.astype(np.int32)), tokens, *rows.columns[2:]], ["part", "before", "n_tokens", "tokens", *rows.schema.names[2:]])
                before += int(bounds[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, order: Sequence[str] | None = None) -> None:
    """Writes the token ids of every text, in ascending order of id (or of the given columns), with all other columns as metadata."""
    meta = unclashed(docs.drop(text_col), ["part", "before", "n_tokens", "tokens"]).columns
    rows = docs.select(F.xxhash64(text_col).alias("__content"), F.col(text_col).alias("__text"), *meta)
    order = [*(order or []), id_col, "__content"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*meta).schema)
    coded = rows.mapInArrow(_encode(tokenizer, end_id), f"part int, before bigint, n_tokens int, tokens array<int>, {kinds}")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "parquet.page.write-checksum.enabled": "true"}
    coded.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        edge, flat = np.array(lists.offsets), lists.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()), pa.array(np.diff(edge), pa.int64()), *batch.columns[1:]], ["ids_crc32", "n_tokens", *batch.schema.names[1:]])


def read_tokens(spark, path: str) -> DataFrame:
    """The rows as written, with start: the number of ids of all texts before."""
    rows = spark.read.parquet(path)
    return rows.join(_starts(rows), "part").withColumn("start", F.col("base") + F.col("before")).drop("part", "before", "base")


def _starts(rows: DataFrame) -> DataFrame:
    """The tokens before each part: a row per part, summed over the part numbers."""
    from pyspark.sql import Window

    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def token_digests(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and the unsigned CRC-32 of the little-endian 32-bit ids, all from the files."""
    rows = spark.read.parquet(path)
    kind = rows.schema[id_col].dataType.simpleString()
    read = rows.select("tokens", F.col(id_col).alias("id"), "part", "before").mapInArrow(_checksums, f"ids_crc32 bigint, n_tokens bigint, id {kind}, part int, before bigint")
    return read.join(_starts(rows.select("part", "n_tokens")), "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, order: Sequence[str] | None = None) -> DataFrame:
    """Writes the ids, reads the files back and returns their digests."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col, end_id, order)
    return token_digests(spark, path, id_col)
