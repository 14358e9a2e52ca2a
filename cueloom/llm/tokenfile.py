"""Token ids in packs of separately compressed documents that share one trained zstandard dictionary.

A pack (about PACK_BYTES) is a byte string of its own: `TOKPACK1`, the 32-byte sha256 of the
dictionary, the bytes per id and the number of documents, the frames' end offsets (unsigned 64-bit
little-endian), then one zstandard frame per document. A table of packs also has the pack's index
(doc_id, offset, length, number of ids) as columns, so the index is read without the packs and one
short document costs one frame. Packs are in ascending doc_id order: range partitions are sorted, and
`(shard, seq)` orders the packs.

The dictionary is trained on a bounded sample: documents drawn by hash with an expected number of
SAMPLE_DOCS, and of each at most SAMPLE_PIECES pieces of PIECE_BYTES at hashed places. All documents
are encoded whole, once, in the task that sorts their range and writes their pack.

Defined results: null text is an empty document (only the end id); null ids come first; repeated rows
are stored one by one; a table with too little text for a dictionary is stored without one (hash of
the empty string); an empty table gives no packs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.llm.common import shared_folder, small_side, stored
from cueloom.llm.encoding import unit_encoder

MAGIC = b"TOKPACK1"
END_ID = 0
PACK_BYTES = 1 << 20
DICT_BYTES = 1 << 16
SAMPLE_DOCS = 1_500
SAMPLE_PIECES = 4
PIECE_BYTES = 2_048
LEVEL = 1

_INDEX = "array<struct<doc_id:bigint,offset:bigint,length:bigint,n_tokens:bigint>>"
PACKS = f"shard int, seq int, n_docs bigint, n_tokens bigint, dict_sha256 string, index {_INDEX}, pack binary"


def train_dictionary(docs: DataFrame, tokenizer: str, seed: int = 17) -> bytes:
    """A shared dictionary from the bounded sample; empty if there is too little to learn from."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.octet_length("text")), F.lit(1 << 30))
    picked = docs.where(F.col("text").isNotNull() & (draw < int(share * (1 << 30)))).select("text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unit_encoder(tokenizer)
        for batch in batches:
            out = []
            for ids, sizes in encode(batch.column(0), END_ID):
                for doc in np.split(ids, np.cumsum(sizes)[:-1]):
                    raw = doc.tobytes()
                    blocks = -(-len(raw) // PIECE_BYTES)
                    at = {zlib.crc32(raw[:64], k) % blocks for k in range(SAMPLE_PIECES)}
                    out += [raw[b * PIECE_BYTES : (b + 1) * PIECE_BYTES] for b in sorted(at)]
            yield pa.record_batch([pa.array(out, pa.binary())], ["piece"])

    # at most about SAMPLE_DOCS * SAMPLE_PIECES * PIECE_BYTES = 12 MB
    samples = sorted(bytes(r[0]) for r in picked.mapInArrow(pieces, "piece binary").collect())
    if len(samples) < 32 or sum(map(len, samples)) < 4 * 8_192:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack(frames: list[bytes], digest: bytes, width: int) -> bytes:
    ends = np.cumsum([len(f) for f in frames], dtype="<u8")
    return b"".join([MAGIC, digest, struct.pack("<BI", width, len(frames)), ends.tobytes(), *frames])


def encode_packs(docs: DataFrame, tokenizer: str, dictionary: bytes, end_id: int = END_ID) -> DataFrame:
    """Packs of all documents in ascending doc_id order."""
    digest = hashlib.sha256(dictionary).digest()

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unit_encoder(tokenizer)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        frames: list[bytes] = []
        index: list[dict] = []
        shard, seq, held = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal frames, index, seq, held
            row = {"shard": shard, "seq": seq, "n_docs": len(index), "n_tokens": sum(x["n_tokens"] for x in index), "dict_sha256": digest.hex(), "index": index, "pack": _pack(frames, digest, encode.width)}
            frames, index, seq, held = [], [], seq + 1, 0
            return pa.RecordBatch.from_pylist([row], _PACK_SCHEMA)

        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
            for ids, sizes in encode(batch.column("text"), end_id):
                ends = np.cumsum(sizes)
                for begin, end in zip(ends - sizes, ends, strict=True):
                    frame = press.compress(ids[begin:end].tobytes())
                    index.append({"doc_id": next(names), "offset": held, "length": len(frame), "n_tokens": int(end - begin)})
                    frames.append(frame)
                    held += len(frame)
                    if held >= PACK_BYTES:
                        yield flush()
        if frames:
            yield flush()

    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("_fp"))
    ranged = slim.repartitionByRange("doc_id", "_fp").sortWithinPartitions("doc_id", "_fp")
    return ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(packs, PACKS)


_PACK_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()),
        ("seq", pa.int32()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("dict_sha256", pa.string()),
        ("index", pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())]))),
        ("pack", pa.binary()),
    ]
)


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write `path`/packs and `path`/dictionary."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    encode_packs(docs, tokenizer, dictionary).write.option("compression", "none").parquet(f"{path}/packs")


def frames_of(pack: bytes, digest: bytes) -> tuple[int, list[bytes]]:
    """Bytes per id and the frames of a pack; refuses a pack made with another dictionary."""
    if pack[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token pack")
    at = len(MAGIC) + 32
    if pack[len(MAGIC) : at] != digest:
        raise ValueError("pack was compressed with another dictionary")
    width, n = struct.unpack_from("<BI", pack, at)
    at += 5
    ends = np.frombuffer(pack, "<u8", n, at)
    body = at + 8 * n
    begins = np.concatenate([[0], ends[:-1]]) if n else ends
    return width, [pack[body + int(b) : body + int(e)] for b, e in zip(begins, ends, strict=True)]


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    stored_as, raw = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(raw).hexdigest() != stored_as:
        raise ValueError("dictionary does not match its hash")
    return bytes(raw)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids_crc32 (and ids as little-endian uint32 bytes)."""
    dictionary = dictionary_of(spark, path)
    digest = hashlib.sha256(dictionary).digest()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for shard, seq, index, pack in zip(*(batch.column(c).to_pylist() for c in ("shard", "seq", "index", "pack")), strict=True):
                width, frames = frames_of(pack, digest)
                ids = [np.frombuffer(press.decompress(f), f"<u{width}").astype("<u4").tobytes() for f in frames]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                columns = [
                    pa.array([x["doc_id"] for x in index], pa.int64()),
                    pa.array([shard] * len(ids), pa.int32()),
                    pa.array([seq] * len(ids), pa.int32()),
                    pa.array(np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                yield pa.record_batch(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    names = ["doc_id", "shard", "seq", "_in_pack", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    packs = spark.read.parquet(f"{path}/packs")
    docs = packs.select("shard", "seq", "index", "pack").mapInArrow(decode, "doc_id bigint, shard int, seq int, _in_pack bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    starts = small_side(stored(pack_starts(packs)))
    return docs.join(starts, ["shard", "seq"]).select("doc_id", (F.col("_base") + F.col("_in_pack")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def pack_starts(packs: DataFrame) -> DataFrame:
    """(shard, seq, _base): ids before each pack. Shard totals are one row per range partition."""
    sizes = packs.select("shard", "seq", "n_tokens")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("_t")).select("shard", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_own"))
    return own.join(totals, "shard").select("shard", "seq", (F.col("_before") + F.col("_own")).alias("_base"))


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of single documents: only packs whose index names them are read, and only their frames."""
    dictionary = dictionary_of(spark, path)
    digest = hashlib.sha256(dictionary).digest()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        want = set(doc_ids)
        for batch in batches:
            found = []
            for index, pack in zip(batch.column("index").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                width, frames = frames_of(pack, digest)
                found += [(x["doc_id"], np.frombuffer(press.decompress(f), f"<u{width}").tolist()) for x, f in zip(index, frames, strict=True) if x["doc_id"] in want]
            yield pa.record_batch([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    packs = spark.read.parquet(f"{path}/packs").where(F.exists("index", lambda x: x["doc_id"].isin(doc_ids)))
    return packs.select("index", "pack").mapInArrow(pick, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to the shared folder in this format and read the documents back."""
    path = shared_folder(docs.sparkSession)
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
