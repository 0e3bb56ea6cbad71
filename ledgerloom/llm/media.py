"""Media columns: content-addressed payloads in tar shards.

Each text becomes an image that holds its UTF-8 bytes, padded with spaces to a
positive multiple of 192, as 8-bit samples: a PNG of 64 RGB pixels a row, its
samples deflated.  A task writes its images to one tar shard of the shared
folder, each payload once a shard under its digest, and the rows carry only
digest, shard, offset and length.  Reading is by ranges: the first 33 bytes of a
member, read alone, fill the metadata columns (width, height, bits, colour); a second
read of the whole member gives the payload back.

A shard is written under a name of its own attempt, and the rows name the shard
that their own attempt wrote: a task that runs again leaves a shard that no row
names, never a mixed one.  The index is written, so a lost executor costs only
the reads of its own shards.

Defined cases: a null text is the empty text (192 spaces); equal texts have
equal values whatever shard they lie in; repeated rows give repeated rows; other
columns are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

UNIT, WIDTH, PIXEL = 192, 64, 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: Reads are dealt by shard and range of this size, in as many tasks as the media need.
SPREAD_BYTES = 16 << 20


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    row = WIDTH * PIXEL
    rows = b"".join(b"\0" + payload[k : k + row] for k in range(0, len(payload), row))
    head = struct.pack(">IIBBBBB", WIDTH, len(payload) // row, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type from a member's first 33 bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or struct.unpack(">I", first[29:33])[0] != zlib.crc32(first[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", first[16:26])


def from_png(media: bytes) -> bytes:
    at, data = 8, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows, row = zlib.decompress(b"".join(data)), 1 + WIDTH * PIXEL
    return b"".join(rows[k + 1 : k + row] for k in range(0, len(rows), row))


def _open(uri: str):
    """The file system and path of a folder; local, object stores and HDFS alike."""
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, id_type: pa.DataType):
    def run(batches):
        fs, root = _open(folder)
        name = f"{root}/{uuid.uuid4().hex}.tar"
        stream, at, known = None, 0, {}
        for batch in batches:
            texts, keys, offsets, lengths, sizes, paths = batch.column(1), [], [], [], [], []
            for k in range(batch.num_rows):
                n, payload = payload_of(texts[k].as_py())
                key = hashlib.sha256(payload).hexdigest()
                if key not in known:
                    if stream is None:
                        fs.create_dir(root, recursive=True)
                        stream = fs.open_output_stream(name)
                    media = to_png(payload)
                    info = tarfile.TarInfo(f"{key}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    stream.write(head + media + b"\0" * (-len(media) % 512))
                    known[key] = (at + len(head), len(media))
                    at += len(head) + len(media) + (-len(media) % 512)
                offset, length = known[key]
                keys.append(key)
                offsets.append(offset)
                lengths.append(length)
                sizes.append(n)
                paths.append(name.rsplit("/", 1)[1])
            longs = [pa.array(x, pa.int64()) for x in (offsets, lengths, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(paths, pa.string()), *longs], ["doc_id", "digest", "shard", "offset", "length", "n_bytes"])
        if stream is not None:
            stream.write(b"\0" * 1024)
            stream.close()

    return run


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; the index ``doc_id, digest, shard, offset, length, n_bytes`` (written)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(texts.mapInArrow(_write(folder, None), f"doc_id {id_type}, digest string, shard string, offset long, length long, n_bytes long"), "media-index")


class _Shards:
    """Range reads, with the last shard kept open."""

    def __init__(self, folder: str):
        self.fs, self.root = _open(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def _headers(folder: str):
    def run(batches):
        shards = _Shards(folder)
        for batch in batches:
            cols = batch.select(["shard", "offset"]).to_pydict()
            found = [png_header(shards.read(s, o, HEADER_BYTES)) for s, o in zip(cols["shard"], cols["offset"], strict=True)]
            meta = [pa.array([x[k] for x in found], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *meta], [*batch.schema.names, "width", "height", "bits", "colour"])

    return run


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with ``width, height, bits, colour``, from header-only range reads."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.mapInArrow(_headers(folder), f"{columns}, width int, height int, bits int, colour int")


def _payloads(folder: str):
    """Reads whole members and checks them; passes the first columns on."""

    def run(batches):
        shards = _Shards(folder)
        for batch in batches:
            rows = batch.select(["digest", "shard", "offset", "length"]).to_pylist()
            out, seen, last = [], {}, None
            for r in rows:
                if r["shard"] != last:
                    seen, last = {}, r["shard"]
                if r["digest"] not in seen:
                    media = shards.read(r["shard"], r["offset"], r["length"])
                    payload = from_png(media)
                    seen[r["digest"]] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{sum(payload) / len(payload):.4f}")
                out.append(seen[r["digest"]])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            new = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "mean"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], [*batch.schema.names, *new])

    return run


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Metadata from header-only reads, checksums and features of the payloads as stored; one row per index row."""
    spread = index.repartition(F.col("shard"), F.expr(f"offset div {SPREAD_BYTES}"))
    meta = with_metadata(spread, folder)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in meta.schema.fields)
    read = meta.mapInArrow(_payloads(folder), f"{columns}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, mean string")
    feature = F.format_string("png %dx%dx%d colour %d mean %s", "width", "height", "bits", "colour", "mean")
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", "bits", "colour")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, then read it back; see the module's text."""
    folder = new_path(docs.sparkSession, "media")
    return read_back(store(docs, folder, id_col, text_col), folder)
