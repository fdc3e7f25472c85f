"""Token-ID output by fixed-width bit packing.

Documents are range-partitioned by id (ties: by a hash of the text, so that one id with many rows
is split too), sorted in the partition, encoded and appended to one shard file each. A shard is

    header   8 bytes magic, then little-endian uint32: bits, block_ids
    blocks   ids of ``bits`` bits each, low bit first; ``block_ids`` ids a block, the last shorter
    footer   uint64 block offsets [n_blocks], uint64 document starts [n_docs + 1],
             int64 document ids [n_docs], uint8 id validity [n_docs]
    tail     little-endian uint64: footer offset, n_ids, n_docs, n_blocks, then the magic again

``bits`` is the least width that holds the vocabulary. A reader finds the id at any place from its
block's offset and unpacks whole blocks with numpy. Shards are written block by block in the
shared folder under a name of the task attempt's own; only attempts that Spark commits are named
in the manifest, so retries after a lost executor leave no wrong shard behind.

Defined cases: a null or empty text is only its end id; a null doc_id sorts first; repeated ids
keep all their rows, ordered by text hash and text; a very long text spans as many blocks as it
needs; an empty table gives no shard; extra columns are not stored.

The folder must be one that pyarrow's file systems open on the executors (``file``, ``hdfs``, ``s3``,
``gs``); schemes that only Hadoop's readers know fail at the first shard.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import REMEMBERED, map_arrow
from .kernel import slices
from ..store import materialize, new_path, qualified

MAGIC = b"SLBITS01"
BLOCK_IDS = 1 << 16
#: Bytes of rows for a shard, and shards at most.
SHARD_BYTES = 512 << 20
MAX_SHARDS = 1 << 18
_TAIL = struct.Struct("<QQQQ8s")

#: Pieces whose ids a worker remembers at most, and the longest of them in bytes.
MEMORY_PIECES, MEMORY_BYTES = 800_000, 64
CALL_BYTES = 1 << 20
#: The pre-tokenizer's pattern (a fixed value of the vocabulary's format), and the same over lower-cased Latin-1 bytes.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N, _S = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\t-\r \x85\xa0"
_LATIN_RUNS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%b]+|[%b]|[^%b%b%b]+" % (_L, _N, _L, _N, _S))
_LATIN_LOWER = bytes(ord(chr(b).lower()) for b in range(256))


def width_of(vocabulary: int) -> int:
    """Least number of bits that holds the ids 0 .. vocabulary - 1."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (uint32) as ``bits`` bits each, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = ((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    """Writes one shard; holds a block of ids and the document index in memory."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.n_ids, self.at, self.pending, self.waiting = 0, 0, [], 0
        self.blocks: list[int] = []
        self.starts, self.doc_ids, self.valid = [0], [], []
        self._put(MAGIC + struct.pack("<II", bits, block_ids))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= self.block_ids or last and at < len(ids):
            self.blocks.append(self.at)
            self._put(pack(ids[at : at + self.block_ids], self.bits))
            at += self.block_ids
        self.pending, self.waiting = ([ids[at:]] if at < len(ids) else []), max(0, len(ids) - at)

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.valid.append(doc_id is not None)
        if self.waiting >= 4 * self.block_ids:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        footer = self.at
        for array, kind in ((self.blocks, "<u8"), (self.starts, "<u8"), (self.doc_ids, "<i8"), (self.valid, "u1")):
            self._put(np.array(array, kind).tobytes())
        self._put(_TAIL.pack(footer, self.n_ids, len(self.doc_ids), len(self.blocks), MAGIC))


class ShardReader:
    """Random access to one shard."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _TAIL.size)
        footer, self.n_ids, self.n_docs, n_blocks, magic = _TAIL.unpack(source.read(_TAIL.size))
        source.seek(0)
        head = source.read(16)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        source.seek(footer)
        take = lambda kind, n: np.frombuffer(source.read(np.dtype(kind).itemsize * n), kind)
        self.blocks, self.starts, self.doc_ids, self.valid = take("<u8", n_blocks), take("<u8", self.n_docs + 1).astype(np.int64), take("<i8", self.n_docs), take("u1", self.n_docs).astype(bool)

    def block(self, b: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - b * self.block_ids)
        self.source.seek(int(self.blocks[b]))
        return unpack(self.source.read((n * self.bits + 7) // 8), n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start .. stop - 1 of the shard."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        got = np.concatenate([self.block(b) for b in range(first, (stop - 1) // self.block_ids + 1)])
        return got[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in order; every block is read once."""
        held, base, nxt = np.zeros(0, np.uint32), 0, 0
        for d in range(self.n_docs):
            start, stop = int(self.starts[d]), int(self.starts[d + 1])
            parts = [held[start - base :]]
            have = base + len(held)
            while have < stop:
                parts.append(self.block(nxt))
                nxt += 1
                have += len(parts[-1])
            held, base = (np.concatenate(parts) if len(parts) > 1 else parts[0]), start
            yield held[: stop - start]


def open_shard(uri: str) -> ShardReader:
    store, path = fs.FileSystem.from_uri(uri)
    return ShardReader(store.open_input_file(path), store.get_file_info(path).size)


class RunEncoder:
    """Ids of texts by the tokenizers library, as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer cuts a normalised text into runs and every run's last token ends
    a word, so a text's ids are those of its runs, one after another. In texts of Latin-1 characters
    runs are found by the same pattern over lower-cased bytes; other texts are cut at ASCII white
    space, which the pre-tokenizer drops. Ids of runs and pieces are remembered; new runs are encoded
    together, as one text, and told apart by their word ends. ``safe`` tells whether the vocabulary
    is of that kind; else, and for texts with what may be a special token, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values(), default=0) + 1
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.safe = bool(
            self.end
            and sorted(s["type"] for s in steps) == ["Lowercase", "NFC", "Replace"]
            and all(s["type"] != "Replace" or s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
            and splits[0].get("type") == "Split" and splits[0].get("invert") and splits[0].get("behavior") == "Removed" and splits[0]["pattern"] == {"Regex": _RUNS}
            and all(a["content"].startswith("<|") and not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not any(c.isspace() for c in a["content"]) for a in spec.get("added_tokens", []))
        )
        self.last = np.zeros(self.vocabulary, bool)
        self.last[[i for t, i in vocabulary.items() if self.end and t.endswith(self.end)]] = True
        self.runs: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[bytes]) -> list[bytes]:
        """One call for all; a run has one word end, its last id."""
        ids = np.array(self.tok.encode_batch_fast([b" ".join(runs).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(runs) or ends[-1] != len(ids):
            return self._encode([r.decode("latin-1") for r in runs])
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _learn(self, memory: dict, wanted: set, encode) -> list:
        """Put all that is wanted into ``memory``, emptied first where it would grow too large; the long ones are returned, to be taken out again."""
        missing = [x for x in wanted if x not in memory]
        if len(memory) + len(missing) > MEMORY_PIECES:
            memory.clear()
            missing = [*wanted]
        at = 0
        while at < len(missing):
            upto, total = at, 0
            while upto < len(missing) and (upto == at or total < CALL_BYTES):
                total += len(missing[upto])
                upto += 1
            memory.update(zip(missing[at:upto], encode(missing[at:upto]), strict=True))
            at = upto
        return [x for x in missing if len(x) > MEMORY_BYTES]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.safe:
            return self._encode([t.decode("utf-8", "replace") for t in texts])
        latin: dict[int, list[bytes]] = {}
        other: dict[int, list[str]] = {}
        out: list[bytes] = [b""] * len(texts)
        for i, t in enumerate(texts):
            if b"<|" in t:
                out[i] = self._encode([t.decode("utf-8", "replace")])[0]
                continue
            if not t.isascii():
                try:
                    t = t.decode().encode("latin-1")
                except UnicodeError:
                    other[i] = [p.decode("utf-8", "replace") for p in t.split()]
                    continue
            latin[i] = _LATIN_RUNS.findall(t.translate(_LATIN_LOWER))
        for memory, parts, encode in ((self.runs, latin, self._encode_runs), (self.pieces, other, self._encode)):
            if parts:
                long = self._learn(memory, set().union(*parts.values()), encode)
                for i, part in parts.items():
                    out[i] = b"".join(map(memory.__getitem__, part))
                for x in long:
                    del memory[x]
        return out


_encoders: dict[str, RunEncoder] = {}
REMEMBERED["ids"] = _encoders.clear


def open_encoder(path: str) -> RunEncoder:
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("uri", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def shard_number(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for the size that Spark estimates of the rows; 0 where those of a usual shuffle are enough."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = min(-(-size // shard_bytes), MAX_SHARDS)
    return n if n > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def write_shards(docs: DataFrame, tokenizer_path: str, out_uri: str, end_id: int | None, text_col: str = "text", id_col: str = "doc_id", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and write all texts below ``out_uri``; the manifest has a row for each shard, in order of ids."""
    end, out_uri = np.array([] if end_id is None else [end_id], np.uint32), qualified(docs.sparkSession, out_uri)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    n_shards = shard_number(docs)
    ranges = [n_shards] if n_shards else []
    placed = rows.repartitionByRange(*ranges, F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "text").withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        encoder, writer, sink, uri, shard = open_encoder(tokenizer_path), None, None, "", 0
        bits = width_of(max(encoder.vocabulary, (end_id or 0) + 1))
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    shard = part.column("shard")[0].as_py()
                    uri = f"{out_uri}/shard-{shard:07d}-{uuid.uuid4().hex}.bits"
                    store, path = fs.FileSystem.from_uri(uri)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(path)
                    writer = ShardWriter(sink, bits, block_ids)
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    writer.append(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids}], schema=schema)

    return materialize(map_arrow(placed, write, MANIFEST, keeps="ids"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of all shards: doc_id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian uint32)."""

    def read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, rows, size = open_shard(uri), [], 0
                for d, ids in enumerate(reader.documents()):
                    rows.append({"doc_id": int(reader.doc_ids[d]) if reader.valid[d] else None, "start": base + int(reader.starts[d]), "n_tokens": len(ids), "ids": ids.astype("<u4").tobytes()})
                    size += len(ids)
                    if size >= 1 << 19:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, manifest.count())
    base = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # a row for each shard
    return map_arrow(manifest.select("uri", base.alias("base")).repartition(n), read, ENCODED)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int | None, out_uri: str | None = None, **columns: str) -> DataFrame:
    """Write the shards and read them back."""
    return read_shards(write_shards(docs, tokenizer_path, out_uri or new_path(docs.sparkSession, "tokens"), end_id, **columns))


