"""Media columns: TIFF files to one row per page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte sizes of field types, tags and compressions of TIFF 6.0 and its technical notes.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: The most bytes of pixels that one stored byte can stand for.
MOST_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 2730, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Bytes of pixels that one output batch holds, or one page.
BATCH_BYTES = 4_000_000


def unpack_bits(data: bytes, need: int) -> bytes:
    """At least the first `need` bytes, where there are as many."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < need:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes, need: int) -> bytes:
    """At least the first `need` bytes, where there are as many. Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    out, table, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], None
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        if len(out) >= need:
            break
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            if code > len(table):
                raise ValueError("LZW code out of range")
            table.append(last + word[:1])
        out += word
        last = word
        width = min(12, (len(table) + 1).bit_length())
    return bytes(out)


def _decoded(data: bytes, compression: int, need: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, need)
    if compression == LZW:
        return unpack_lzw(data, need)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, need)
    raise ValueError(f"compression {compression}")


def _block(raw: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Samples of one strip or tile as bytes in the machine's little order, predictor undone: (rows, columns, samples * bytes of one)."""
    size = bits // 8
    need = rows * columns * samples * size
    if len(raw) < need:
        raise ValueError("a strip or tile is too short")
    flat = np.frombuffer(raw, dtype=np.uint8, count=need)
    if predictor == 3:
        # Differences of bytes along a row whose values were split into planes, the most significant first.
        planes = np.add.accumulate(flat.reshape(rows, columns * size, samples), axis=1, dtype=np.uint8)
        return planes.reshape(rows, size, columns * samples)[:, ::-1].transpose(0, 2, 1).reshape(rows, columns, samples * size)
    values = flat.view(f"{order}u{size}").reshape(rows, columns, samples)
    if predictor == 2:
        values = np.add.accumulate(values.astype(f"<u{size}"), axis=1, dtype=f"<u{size}")
    return np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8).reshape(rows, columns, samples * size)


def read_pages(data: bytes) -> Iterator[dict]:
    """The pages of a TIFF file: page, width, height, samples, bits, pixels (rows of interleaved samples, little-endian).

    Walks the chain of image directories; decodes plain, PackBits, LZW and deflate strips and tiles of 8, 16, 32 or 64 bits a
    sample, planes together or apart, and undoes horizontal and floating-point predictors. Raises ValueError on anything else, before
    memory is taken for more pixels than the file's bytes can stand for. Pages may share strips; all together may be as large as
    the best packed file of that size. Pages come one by one; only one is held.
    """
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, at = struct.unpack_from(f"{order}HI", data, 2)
        if magic != 42:
            raise ValueError("not a TIFF")
        seen, page, taken = set(), 0, 0
        while at:
            if at in seen:
                raise ValueError("the directories form a ring")
            seen.add(at)
            fields, at = _directory(data, at, order)
            found = {"page": page} | _page(data, fields, order)
            taken += len(found["pixels"])
            if taken > max(MOST_GROWTH.values()) * len(data):
                raise ValueError("more pages than the file can hold")
            yield found
            page += 1
    except (KeyError, struct.error, zlib.error, IndexError, TypeError) as e:
        raise ValueError(f"not a readable TIFF: {e!r}") from e


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind in TYPE_CODE:
            where = at + 10 + 12 * i
            if TYPE_SIZE[kind] * count > 4:
                (where,) = struct.unpack_from(f"{order}I", data, where)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, where))
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[int, list], order: str) -> dict:
    width, height, samples = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
    depths, apart = f.get(BITS, [1]), f.get(PLANAR, [1])[0] == 2
    bits = depths[0]
    if bits not in (8, 16, 32, 64) or any(b != bits for b in depths):
        raise ValueError(f"{depths} bits a sample")
    compression, predictor = f.get(COMPRESSION, [1])[0], f.get(PREDICTOR, [1])[0]
    if predictor not in (1, 2, 3):
        raise ValueError(f"predictor {predictor}")
    if TILE_OFFSETS in f:
        high, wide, offsets, counts = f[TILE_HEIGHT][0], f[TILE_WIDTH][0], f[TILE_OFFSETS], f[TILE_COUNTS]
    else:
        high, wide, offsets, counts = min(f.get(ROWS_PER_STRIP, [height])[0], height), width, f[STRIP_OFFSETS], f[STRIP_COUNTS]
    if min(width, height, samples, high, wide) < 1 or samples > len(depths) > 1:
        raise ValueError(f"a page of {width} x {height} x {samples} in blocks of {wide} x {high}")
    blocks = -(-width // wide) * -(-height // high) * (samples if apart else 1)
    if blocks > min(len(offsets), len(counts)):
        raise ValueError(f"{blocks} blocks, {len(offsets)} places")
    if width * height * samples * bits // 8 > MOST_GROWTH.get(compression, 1) * len(data):
        raise ValueError("more pixels than the file can hold")
    in_block, size = 1 if apart else samples, bits // 8
    out = np.zeros((height, width, samples * size), dtype=np.uint8)
    across, down = -(-width // wide), -(-height // high)
    for k in range(across * down * (samples if apart else 1)):
        plane, place = divmod(k, across * down)
        top, left = place // across * high, place % across * wide
        rows = high if TILE_OFFSETS in f else min(high, height - top)
        need = rows * wide * in_block * size
        block = _block(_decoded(data[offsets[k] : offsets[k] + counts[k]], compression, need), rows, wide, in_block, bits, predictor, order)
        target = out[top : top + rows, left : left + wide, plane * size : plane * size + in_block * size]
        target[:] = block[: target.shape[0], : target.shape[1]]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "pixels": out.tobytes()}


def write_page(pixels: bytes, width: int, samples: int, rows_per_strip: int = 64) -> bytes:
    """A little-endian TIFF of one page of 8-bit samples: deflate strips with horizontal differences."""
    image = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, width, samples)
    height = len(image)
    diff = image.copy()
    diff[:, 1:] -= image[:, :-1]
    strips = [zlib.compress(diff[i : i + rows_per_strip].tobytes(), 1) for i in range(0, height, rows_per_strip)]
    offsets = (8 + np.concatenate(([0], np.cumsum([len(s) for s in strips])))).tolist()
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    fields = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8] * samples), (COMPRESSION, "H", [DEFLATE]), (PHOTOMETRIC, "H", [2 if samples == 3 else 1]), (STRIP_OFFSETS, "I", offsets[:-1]), (SAMPLES, "H", [samples]), (ROWS_PER_STRIP, "I", [rows_per_strip]), (STRIP_COUNTS, "I", [len(s) for s in strips]), (PLANAR, "H", [1]), (PREDICTOR, "H", [2])]
    at = 8 + len(body)
    extra, entries = b"", b""
    for tag, code, values in fields:
        raw = struct.pack(f"<{len(values)}{code}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, 3 if code == "H" else 4, len(values), at + 6 + 12 * len(fields) + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, 3 if code == "H" else 4, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra


def feature_of(page: dict) -> str:
    """Size, sum of samples and a hash of 8 x 8 cells (a bit for each that is brighter than the page), in whole numbers."""
    raw = np.frombuffer(page["pixels"], dtype=np.uint8).reshape(page["height"], -1).astype(np.int64)
    down = np.unique(np.arange(8) * raw.shape[0] // 8)
    over = np.unique(np.arange(8) * raw.shape[1] // 8)
    cells = np.add.reduceat(np.add.reduceat(raw, down, axis=0), over, axis=1)
    area = np.outer(np.diff(np.append(down, raw.shape[0])), np.diff(np.append(over, raw.shape[1])))
    bright = (cells * raw.size > raw.sum() * area).ravel()
    return f"{page['width']}x{page['height']}x{page['samples']}:{int(raw.sum())}:{int(''.join('01'[b] for b in bright.tolist()), 2):x}"


def tiff_pages(files: DataFrame, content_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per page of every TIFF in content_col: the columns in keep, page, width, height, samples, bits, pixels, feature, error.

    A null, empty, broken or unsupported file gives one row with what is wrong in error and nulls for the page; a file that
    breaks on a later page gives its pages before that too. Repeated rows are read each; an empty table gives an empty result.
    """
    kinds = {"page": pa.int64(), "width": pa.int64(), "height": pa.int64(), "samples": pa.int64(), "bits": pa.int64(), "pixels": pa.binary(), "feature": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            origin: list[int] = []
            held = 0

            def table() -> pa.RecordBatch:
                kept = [batch.column(i).take(pa.array(origin, pa.int64())) for i in range(len(keep))]  # noqa: B023
                return pa.RecordBatch.from_arrays(kept + [pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=[*keep, *kinds])  # noqa: B023

            for i, content in enumerate(batch.column(len(keep))):
                data = content.as_py()
                try:
                    for page in read_pages(data or b""):
                        rows.append(page | {"feature": feature_of(page) if page["pixels"] else ""})
                        origin.append(i)
                        held += len(page["pixels"])
                        if held > BATCH_BYTES:
                            yield table()
                            rows, origin, held = [], [], 0
                except ValueError as e:
                    rows.append({"error": str(e)})
                    origin.append(i)
                if held > BATCH_BYTES:
                    yield table()
                    rows, origin, held = [], [], 0
            if rows:
                yield table()

    own = files.select(*keep, F.col(content_col).alias("content"))
    types = [f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep]
    return own.mapInArrow(run, ", ".join(types) + ", page bigint, width bigint, height bigint, samples bigint, bits bigint, pixels binary, feature string, error string")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, samples: int = 3) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes as the rows of a TIFF page, filled with spaces to whole rows, one at least. Null text is empty."""
    row = width * samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files, held, start = [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                files.append(write_page(raw.ljust(max(1, -(-len(raw) // row)) * row), width, samples))
                held += len(files[-1])
                if held > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sizes)), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    sizes, files, held, start = [], [], 0, i + 1

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")
