"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks of about a kilobyte
whose borders depend on nearby content alone, so passages that documents share
yield equal chunks. Each distinct chunk that occurs more than once is encoded
once, by the document where it occurs first; its ids are joined into the others
by strong digest. Chunks that occur once are encoded where they stand.

Joining: an encoder splits a text before it merges, and some splits are certain
from the two characters at them (a word character run ends before something
else; a non-space is followed by a space). Between the last certain split of
what came before and the first one in the next chunk, the text is encoded
again; the window grows until its ends agree with ids of both chunks, at
positions where both chunks have a split too. So the joined ids equal those of
the whole text.

Edge cases: a null text is an empty one, without ids; a text without certain
splits ends up in one window; special strings are cut out first, as the
tokenizers library does; equal rows (same id and text) are encoded once and
each get the result; ids may be null or repeated; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import vocab
from granary.llm.common import materialize, table

#: A chunk border has this many leading zero bits in the rolling hash: chunks of 2^BITS bytes on average, besides the least size.
BITS = 10
LEAST_BYTES = 256
WINDOW = 32

_CERTAIN = r"(?:(?<=[^\s\x00-\x20\x85\xa0])(?=[ \n\t\r])|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}]))"
_FIRST, _LAST = regex.compile(_CERTAIN), regex.compile("(?r)" + _CERTAIN)
#: The rolling hash's value for each byte, from a fixed rule.
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def borders(data: bytes) -> list[int]:
    """End offsets of the chunks of ``data``, the last one included; never inside a character."""
    n = len(data)
    if n <= LEAST_BYTES:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    width = 1
    while width < WINDOW:  # h[i] = sum of GEAR[b[i-j]] << j over the last `width` bytes
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    ends = np.flatnonzero((h[:-1] >> np.uint32(32 - BITS) == 0) & ((b[1:] & 0xC0) != 0x80)) + 1
    cuts, last = [], 0
    for e in ends.tolist():
        if e - last >= LEAST_BYTES:
            cuts.append(e)
            last = e
    return [*cuts, n]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def segments(text: str, enc: vocab.ByteEncoder) -> list[str]:
    """The text cut at special strings, which stay as segments of their own."""
    return [s for s in enc.splitter.split(text) if s] if enc.splitter else [text]


def chunks(text: str, enc: vocab.ByteEncoder) -> list[tuple[str, bool]]:
    """The chunks of a text in order, with whether each opens a segment (nothing is joined across that)."""
    out = []
    for segment in segments(text, enc):
        if segment in enc.special:
            out.append((segment, True))
            continue
        data, at = segment.encode(), 0
        for end in borders(data):
            out.append((data[at:end].decode(), at == 0))
            at = end
    return out


def encode_chunk(chunk: str, enc: vocab.ByteEncoder) -> list[int]:
    return [enc.special[chunk]] if chunk in enc.special else enc.encode_plain(chunk)


def _at_byte(ids: np.ndarray, enc: vocab.ByteEncoder, offset: int) -> int:
    """How many ids make up the first ``offset`` bytes; -1 if none do exactly."""
    ends = np.cumsum(enc.length_of[ids])
    k = int(np.searchsorted(ends, offset))
    return k + 1 if k < len(ends) and ends[k] == offset else -1


def join_chunks(parts: list[tuple[str, bool, np.ndarray]], enc: vocab.ByteEncoder) -> np.ndarray:
    """The ids of the whole text from (chunk, opens a segment, the chunk's own ids)."""
    out: list[np.ndarray] = []
    pending = ""  # text after the last agreed split, not in `out` yet
    settled = True

    def flush() -> None:
        nonlocal pending
        if pending:
            out.append(np.array(encode_chunk(pending, enc), np.int64))
        pending = ""

    for k, (text, opens, ids) in enumerate(parts):
        if opens:
            flush()
            settled = True
        closes = k + 1 == len(parts) or parts[k + 1][1]
        first, start = 0, 0
        if not settled or pending:
            m, start = _FIRST.search(text, 1), -1
            while m and start < 0:  # until the chunk has a split there too
                first = m.start()
                start = _at_byte(ids, enc, len(text[:first].encode()))
                m = None if start >= 0 else _FIRST.search(text, first + 1)
            if start < 0:
                pending += text
                settled = False
                if closes:
                    flush()
                continue
            pending += text[:first]
            flush()
        settled = True
        if closes:
            out.append(ids[start:])
            continue
        m, end, last = _LAST.search(text, first + 1), -1, first
        while m and end < 0:
            last = m.start()
            end = _at_byte(ids, enc, len(text[:last].encode()))
            m = None if end >= 0 else _LAST.search(text, first + 1, last)
        if end < 0:
            last, end = first, start
        out.append(ids[start:end])
        pending = text[last:]
        settled = False
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def encode_text(text: str, enc: vocab.ByteEncoder) -> np.ndarray:
    """One text through chunks and repaired joins, without reuse: the same ids as encoding it whole."""
    return join_chunks([(c, o, np.array(encode_chunk(c, enc), np.int64)) for c, o in chunks(text, enc)], enc)


def _row_key(doc_id: object, text: str) -> bytes:
    return digest(f"{doc_id}\n{text}".encode())


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_CHUNK = pa.schema([("key", pa.binary()), ("pos", pa.int32()), ("digest", pa.binary())])
_TEXT = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("packed", pa.binary())])
_SHARED = pa.schema([("digest", pa.binary()), ("ids", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {"binary": "binary", "int32": "int", "int64": "long", "string": "string"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def chunk_table(docs: DataFrame, file: str) -> DataFrame:
    """Where each chunk occurs, by digest: no text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.byte_encoder(file)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                body = text.as_py() or ""
                key = _row_key(doc_id.as_py(), body)
                rows += [(key, k, digest(c.encode())) for k, (c, _) in enumerate(chunks(body, enc))]
            yield _batch(_CHUNK, rows)

    return docs.select("doc_id", "text").mapInArrow(cut, _ddl(_CHUNK))


def _packed(docs: DataFrame) -> DataFrame:
    """The texts, compressed for their one shuffle."""

    def shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            pairs = [(i.as_py(), t.as_py() or "") for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield _batch(_TEXT, [(_row_key(i, t), i, press.compress(t.encode())) for i, t in pairs])

    return docs.select("doc_id", "text").mapInArrow(shut, _ddl(_TEXT))


def encode_documents(docs: DataFrame, file: str, out: pa.Schema, make) -> DataFrame:
    """Encode every text with chunk reuse; ``make(doc_id, ids, enc)`` turns a document's ids into a row of ``out``."""
    occurrences = materialize(chunk_table(docs, file), "chunks")
    first = F.min(F.struct("key", "pos")).alias("owner")
    shared = occurrences.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    owned = shared.select(F.col("owner.key").alias("key"), F.col("owner.pos").alias("pos")).groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("own"))
    # Both joins below read the same columns of the same rows, so that one exchange of the texts serves both.
    texts = _packed(docs).where("key is not null")

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press, unpress = vocab.byte_encoder(file), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, own in zip(batch.column(1), batch.column(2), strict=True):
                parts = chunks(unpress.decompress(packed.as_py()).decode(), enc)
                for pos in own.as_py():
                    c = parts[pos][0]
                    rows.append((digest(c.encode()), press.compress(np.array(encode_chunk(c, enc), enc.dtype).tobytes())))
            yield _batch(_SHARED, rows)

    encoded = texts.join(owned, "key").select("doc_id", "packed", "own").mapInArrow(encode_owned, _ddl(_SHARED)).dropDuplicates(["digest"])
    needed = occurrences.dropDuplicates(["key", "pos"]).join(encoded, "digest").groupBy("key").agg(F.collect_list(F.struct("pos", "ids")).alias("given"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unpress = vocab.byte_encoder(file), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, packed, given in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                known = {g["pos"]: g["ids"] for g in given.as_py() or ()}
                parts = []
                for k, (c, opens) in enumerate(chunks(unpress.decompress(packed.as_py()).decode(), enc)):
                    ids = np.frombuffer(unpress.decompress(known[k]), enc.dtype).astype(np.int64) if k in known else np.array(encode_chunk(c, enc), np.int64)
                    parts.append((c, opens, ids))
                rows.append(make(doc_id.as_py(), join_chunks(parts, enc), enc))
            yield _batch(out, rows)

    return texts.join(needed, "key", "left").select("doc_id", "packed", "given").mapInArrow(assemble, _ddl(out))


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_ids(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, ids (little-endian uint32)."""
    return encode_documents(docs, file, IDS, lambda doc_id, ids, enc: (doc_id, ids.astype("<u4").tobytes()))


def decode_ids(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id, text, from the result of ``encode_ids``. Bytes that are no UTF-8 become replacement characters."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.byte_encoder(file)
        for batch in batches:
            yield _batch(schema, [(i.as_py(), enc.decode(np.frombuffer(x.as_py(), "<u4").tolist()).decode(errors="replace")) for i, x in zip(batch.column(0), batch.column(1), strict=True)])

    return encoded.select("doc_id", "ids").mapInArrow(decode, _ddl(schema))


def _digests(doc_id: int, ids: np.ndarray, enc: vocab.ByteEncoder) -> tuple:
    text = enc.decode(ids.tolist()).decode(errors="replace")
    return doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def op1_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocab.path(vocab.BYTE_BPE), DIGESTS, _digests)
