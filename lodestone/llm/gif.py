"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

encode_gif and decode_gif are small per-file helpers; Spark deals the rows out. decode_frames gives a table
with one row per frame. A damaged file gives no frames and its reason in the column `error`.

Defined results: null texts are empty, and an empty text is one 64-byte row of zeros; long texts become several
frames of at most FRAME_ROWS rows; equal rows give equal values; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import documents, staged

WIDTH = 64
#: Rows of a frame: 64 kB of samples.
FRAME_ROWS = 1024
#: Hundredths of a second for which each frame of a stored text stands.
DELAY = 4
_GREY = bytes(i for i in range(256) for _ in range(3))
_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_encode(samples: bytes) -> bytes:
    """LZW code stream of 8-bit samples: 256 clears the table, 257 ends."""
    codes: list[int] = [256 << 8]  # codes are held eight bits up, ready to take the next sample
    marks: list[int] = []  # where a fresh table begins
    table: dict[int, int] = {}
    get, add, free = table.get, codes.append, 258 << 8
    current = samples[0] << 8
    for byte in samples[1:]:
        if known := get(pair := current | byte):
            current = known
        else:
            add(current)
            current = byte << 8
            if free < 4096 << 8:
                table[pair] = free
                free += 256
            else:
                add(256 << 8)
                marks.append(len(codes))
                table.clear()
                free = 258 << 8
    add(current)
    add(257 << 8)
    begins = [1, *marks, len(codes)]
    widths = [_WIDTHS[:1], *(_schedule(b - a) for a, b in zip(begins, begins[1:], strict=False))]
    return _pack(np.array(codes, np.int32) >> 8, np.concatenate(widths))


def _bit_widths(n: int, min_bits: int = 8) -> np.ndarray:
    """Bits of each code after a clear: a decoder knows 2**min_bits + k + 1 codes when it reads the k-th."""
    known = (1 << min_bits) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, min_bits + 1, 12)


_WIDTHS = _bit_widths(4096)
_BITS = np.arange(12)


def _schedule(n: int) -> np.ndarray:
    return _WIDTHS[:n] if n <= len(_WIDTHS) else _bit_widths(n)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bits = (codes[:, None] >> _BITS & 1).astype(np.uint8)
    return np.packbits(bits[_BITS < widths[:, None]], bitorder="little").tobytes()


def _segments(stream: bytes, min_bits: int) -> Iterator[list[int]]:
    """The codes between clear codes; widths follow from a code's place, so a whole segment is cut at once."""
    raw = np.zeros(len(stream) + 4, np.int64)
    raw[: len(stream)] = np.frombuffer(stream, np.uint8)
    clear, at, total = 1 << min_bits, 0, 8 * len(stream)
    while at < total:
        n, found = 4096, None
        while found is None:
            widths = _schedule(n) if min_bits == 8 else _bit_widths(n, min_bits)
            ends = at + np.cumsum(widths)
            ends = ends[ends <= total]
            begin = ends - widths[: len(ends)]
            word = raw[begin >> 3] | raw[(begin >> 3) + 1] << 8 | raw[(begin >> 3) + 2] << 16
            codes = word >> (begin & 7) & ((1 << widths[: len(ends)]) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops):
                found = int(stops[0])
            elif len(ends) < n:
                found = len(ends)
            n *= 4
        yield codes[:found].tolist()
        if found == len(ends) or codes[found] == clear + 1:
            return
        at = int(ends[found])


def lzw_decode(stream: bytes, min_bits: int, size: int) -> bytes:
    """Samples of a code stream; raises ValueError if a code is impossible."""
    clear, out = 1 << min_bits, []
    for codes in _segments(stream, min_bits):
        if not codes:
            continue
        if codes[0] >= clear:
            raise ValueError("code out of range")
        table = _SINGLE[:clear] + [b"", b""]
        grow, add = table.append, out.append
        last = table[codes[0]]
        add(last)
        if len(codes) + clear > 4096:
            codes, late = codes[: 4095 - clear], codes[4095 - clear :]
        else:
            late = []
        try:
            for code in codes[1:]:
                grow(last)  # the entry that this code completes, still without its last sample
                last = table[code]
                if code == len(table) - 1:
                    last += last[:1]
                    table[-1] = last
                else:
                    table[-1] += last[:1]
                add(last)
            for code in late:
                add(table[code])
        except IndexError:
            raise ValueError("code out of range") from None
    made = b"".join(out)
    if len(made) > size:
        raise ValueError("more samples than pixels")
    return made


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """Samples as grey 8-bit frames of one width; their number is a multiple of width."""
    height = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), _GREY]
    for top in range(0, height, rows):
        part = samples[top * width : (top + rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0))
        out.append(b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _data(buf: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := buf[at]:
        parts.append(buf[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def read_images(buf: bytes) -> Iterator[dict]:
    """Images of a file in order: place, palette indexes, palette, delay, disposal and transparent index."""
    if buf[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", buf[6:13])
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(buf[at : at + 3 * n], np.uint8).reshape(n, 3)
        at += 3 * n
    delay, disposal, clear = 0, 0, None
    while buf[at] != 0x3B:
        if buf[at] == 0x21:
            label = buf[at + 1]
            data, at = _data(buf, at + 2)
            if label == 0xF9:
                how, delay, index = struct.unpack("<BHB", data[:4])
                disposal, clear = how >> 2 & 7, index if how & 1 else None
            continue
        if buf[at] != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h, how = struct.unpack("<HHHHB", buf[at + 1 : at + 10])
        at += 10
        palette = common
        if how & 0x80:
            n = 2 << (how & 7)
            palette = np.frombuffer(buf[at : at + 3 * n], np.uint8).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("no palette")
        bits = buf[at]
        data, at = _data(buf, at + 1)
        index = np.frombuffer(lzw_decode(data, bits, w * h), np.uint8)
        if len(index) != w * h:
            raise ValueError("missing pixels")
        index = index.reshape(h, w)
        if how & 0x40:
            order = [r for first, step in _PASSES for r in range(first, h, step)]
            index = index[np.argsort(order, kind="stable")]
        yield {"screen": (width, height), "at": (x, y), "index": index, "palette": palette, "delay": delay, "disposal": disposal, "clear": clear}
        delay, disposal, clear = 0, 0, None


def decode_gif(buf: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Composed frames: the hundredths of a second that each stands, and its height x width x RGBA samples."""
    for delay, canvas, _ in compose(buf):
        yield delay, canvas.copy()


def compose(buf: bytes) -> Iterator[tuple[int, np.ndarray, tuple[slice, slice]]]:
    """Delay, canvas (valid until the next step) and the box that the image covers, for each image."""
    canvas = None
    for image in read_images(buf):
        if canvas is None:
            width, height = image["screen"]
            canvas = np.zeros((height, width), "<u4")  # RGBA, one word a pixel
        (x, y), index, palette = image["at"], image["index"], image["palette"]
        colours = np.full((len(palette), 4), 255, np.uint8)
        colours[:, :3] = palette
        colours = colours.view("<u4").ravel()
        kept = canvas.copy() if image["disposal"] == 3 else None
        where = slice(y, y + index.shape[0]), slice(x, x + index.shape[1])
        box = canvas[where]
        index = index[: box.shape[0], : box.shape[1]]
        drawn = colours.take(index, mode="clip")
        box[:] = drawn if image["clear"] is None else np.where(index == image["clear"], box, drawn)
        yield image["delay"], canvas.view(np.uint8).reshape(*canvas.shape, 4), where
        if image["disposal"] == 2:
            box[:] = 0
        elif kept is not None:
            canvas = kept


def histogram(rgba: np.ndarray) -> np.ndarray:
    """64 colour bins: the top two bits of red, green and blue; only opaque pixels count."""
    top = rgba >> 6
    bins = (top[..., 0] << 4) + (top[..., 1] << 2) + top[..., 2]
    seen = rgba[..., 3] == 255
    return np.bincount(bins.ravel() if seen.all() else bins[seen], minlength=64)


def decode_frames(media: DataFrame) -> DataFrame:
    """Timed frames of media (doc_id, media binary): doc_id, frame, start_cs, delay_cs, width, height, rgba, histogram, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, start = [], 0
                try:
                    for k, (delay, rgba) in enumerate(decode_gif(buf or b"")):
                        rows.append((doc_id, k, start, delay, rgba.shape[1], rgba.shape[0], rgba.tobytes(), histogram(rgba).tolist(), None))
                        start += delay
                except (ValueError, IndexError, struct.error) as bad:
                    rows = [(doc_id, None, None, None, None, None, None, None, str(bad) or "damaged")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FRAME_TYPES, strict=True)], names=_FRAME_NAMES)

    schema = "doc_id long, frame int, start_cs long, delay_cs int, width int, height int, rgba binary, histogram array<long>, error string"
    return media.select("doc_id", "media").mapInArrow(run, schema)


_FRAME_NAMES = ["doc_id", "frame", "start_cs", "delay_cs", "width", "height", "rgba", "histogram", "error"]
_FRAME_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]


def store_texts(docs: DataFrame) -> DataFrame:
    """Whole texts as GIF files: doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                made = encode_gif(raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)))
                ids.append(doc_id)
                sizes.append(len(raw))
                media.append(made)
                held += len(made)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    ids, sizes, media, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Read stored texts back and describe them: payload digests and the colour histogram of all frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, buf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, colours, frames, clock = [], np.zeros(64, np.int64), 0, 0
                for delay, rgba, box in compose(buf):
                    rgba = rgba[box]
                    parts.append(rgba[..., 0].tobytes())
                    colours += histogram(rgba)
                    frames += 1
                    clock += delay
                back = b"".join(parts)
                feature = f"frames={frames};cs={clock};hist=" + ",".join(str(int(colours[21 * k])) for k in range(4))
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(buf), hashlib.sha256(buf).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST_TYPES, strict=True)], names=_DIGEST_NAMES)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


_DIGEST_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = staged(store_texts(documents(spark, sf_dir)), "gif")
    return digests(media)
