"""Baseline JPEG media columns: markers, Huffman-coded scans, DC-only luminance thumbnails, hashes.

``dc_thumbnails`` reads any baseline (SOF0, 8 bit, Huffman) JPEG: markers give size, components, tables and restart intervals; the scans are decoded with numpy in
step, one lane for each restart segment of each file of a batch; the DC coefficients of the luminance become a thumbnail of one pixel a block. AC coefficients
are read over. Progressive, arithmetic or 12-bit files raise ``ValueError``.

``encode_payload`` stores bytes losslessly in this form: each byte is the DC coefficient of a flat 8x8 block (quantiser 8, so a block's eight-bit samples all equal the byte), 192 x k blocks
a row, one restart segment a row. The thumbnail of such a file is the payload. A payload beyond a file's 8191 rows goes on in further files, one behind the other.
``stored`` writes the media column as Parquet and reads it back; features come from the bytes that were read.

Defined cases: a null text counts as empty; an empty text is 192 spaces; a null doc_id is kept; rows that repeat get equal rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh_dir

UNIT = 192
MOST_BLOCKS = 65535 // 8
#: Bytes of payload that are coded and decoded at a time.
AT_A_TIME = 1 << 21
#: Code lengths of the DC categories 0 to 8 in files written here: prefix-free and without the all-ones code. With a category's extra bits and the end-of-block
#: bit, every block takes whole bytes (one up to category 6, two in 7, three in 8), so that equal passages are equal bytes to the codec of the table they are stored in.
_DC_LENGTHS = (7, 6, 5, 4, 3, 2, 1, 8, 15)


def _canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a DHT table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((length, code, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For every 16 bits: length of the code at their start * 256 + symbol; 0 for none."""
    table = np.zeros(1 << 16, np.uint16)
    for length, code, symbol in _canonical(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _written_dc() -> tuple[list[int], list[int]]:
    order = sorted(range(9), key=lambda s: (_DC_LENGTHS[s], s))
    return [_DC_LENGTHS.count(n) for n in range(1, 17)], order


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference of -255 to 255 (plus 255): its code with the extra bits and the end-of-block bit 0, and its length."""
    code = {symbol: (length, c) for length, c, symbol in _canonical(*_written_dc())}
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        length, c = code[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        bits[d + 255], size[d + 255] = (((c << s) | extra) << 1), length + s + 1
    return bits, size


_CODES = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(width: int, height: int, interval: int) -> bytes:
    counts, symbols = _written_dc()
    dht = bytes([0x00, *counts, *symbols]) + bytes([0x10, 1, *[0] * 15, 0x00])
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0, *[8] * 64])) + _segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _segment(0xC4, dht) + _segment(0xDD, interval.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _coded_rows(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded, stuffed bytes of all rows (each a restart segment), and where each row ends."""
    level = pixels.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0)) + 255
    bits, size = _CODES[0][diff], _CODES[1][diff]
    pad = -size.sum(axis=1) % 8
    left = (bits << (32 - size).astype(np.uint32)).astype(">u4")
    every = np.unpackbits(left.view(np.uint8).reshape(len(pixels), -1, 4), axis=2)
    used = np.arange(32, dtype=np.int8) < size[:, :, None].astype(np.int8)
    stream, per_row = every[used], size.sum(axis=1)
    if pad.any():  # ones up to the byte
        stream = np.insert(stream, np.repeat(np.cumsum(per_row), pad), 1)
    data = np.packbits(stream)
    ends = np.cumsum(per_row + pad) // 8
    stuffed = np.flatnonzero(data == 255)
    if len(stuffed):
        data = np.insert(data, stuffed + 1, 0)
        ends = ends + np.searchsorted(stuffed, ends, side="left")
    return data, ends


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def _shapes(n: int) -> list[tuple[int, int]]:
    """(blocks a row, rows) of the files that n bytes, a multiple of UNIT, go to."""
    wide = UNIT * max(1, min(MOST_BLOCKS // UNIT, -(-n // (UNIT * MOST_BLOCKS))))
    out = []
    while n >= wide:
        rows = min(n // wide, MOST_BLOCKS)
        out.append((wide, rows))
        n -= wide * rows
    if n:
        out.append((n, 1))
    return out


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 192 bytes) as one or more JPEG files. Rows of equal width are coded together."""
    plans = [_shapes(len(p)) for p in payloads]
    rows: dict[int, list[np.ndarray]] = {}
    for p, plan in zip(payloads, plans):
        at, raw = 0, np.frombuffer(p, np.uint8)
        for wide, high in plan:
            rows.setdefault(wide, []).append(raw[at : at + wide * high].reshape(high, wide))
            at += wide * high
    coded = {}
    for wide, parts in rows.items():
        every, step, pieces = np.concatenate(parts), max(1, (AT_A_TIME // 4) // wide), []
        for i in range(0, len(every), step):
            data, ends = _coded_rows(every[i : i + step])
            raw, begin = data.tobytes(), 0
            for end in ends.tolist():
                pieces.append(raw[begin:end])
                begin = end
        coded[wide] = iter(pieces)
    out = []
    for plan in plans:
        media = []
        for wide, high in plan:
            media.append(_head(8 * wide, 8 * high, wide))
            for r in range(high):
                media.append(next(coded[wide]))
                if r < high - 1:
                    media.append(bytes((0xFF, 0xD0 + r % 8)))
            media.append(b"\xff\xd9")
        out.append(b"".join(media))
    return out


@dataclass
class Frame:
    """What the markers of one file say."""

    width: int = 0
    height: int = 0
    parts: list[dict] = field(default_factory=list)  # id, h, v, quantiser of DC, DC table, AC table
    interval: int = 0
    scan: bytes = b""

    @property
    def luma_blocks(self) -> tuple[int, int]:
        """Columns and rows of luminance blocks that show."""
        return -(-self.width // 8), -(-self.height // 8)

    def mcu(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.parts) == 1:
            return [0]
        return [i for i, c in enumerate(self.parts) for _ in range(c["h"] * c["v"])]

    def mcus(self) -> tuple[int, int]:
        if len(self.parts) == 1:
            return self.luma_blocks
        h, v = (max(c[k] for c in self.parts) for k in ("h", "v"))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(media: bytes) -> list[Frame]:
    """The files in ``media``, one behind the other."""
    out, at = [], 0
    while at < len(media):
        frame, quant, tables = Frame(), {}, {}
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG starts here")
        at += 2
        while True:
            while media[at + 1 : at + 2] == b"\xff":
                at += 1
            if media[at : at + 1] != b"\xff" or at + 4 > len(media):
                raise ValueError("a marker is missing")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    quant[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                    i += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    counts = list(body[i + 1 : i + 17])
                    tables[body[i]] = (tuple(counts), tuple(body[i + 17 : i + 17 + sum(counts)]))
                    i += 17 + sum(counts)
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("only 8 bits a sample are baseline")
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.parts = [{"id": body[i], "h": body[i + 1] >> 4, "v": body[i + 1] & 15, "q": body[i + 2]} for i in range(6, 6 + 3 * body[5], 3)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError(f"not baseline: SOF marker {marker:#x}")
            elif marker == 0xDD:
                frame.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                if body[0] != len(frame.parts):
                    raise ValueError("only files of one interleaved scan are supported")
                chosen = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
                for c in frame.parts:
                    c["dc"], c["ac"], c["q"] = tables[chosen[c["id"]] >> 4], tables[0x10 | chosen[c["id"]] & 15], quant[c["q"]]
                break
        end = at  # of the scan: the next marker that is neither a stuffed byte nor a restart
        while True:
            end = media.find(b"\xff", end)
            if end < 0 or end + 1 >= len(media):
                raise ValueError("the scan has no end")
            if media[end + 1] != 0 and not 0xD0 <= media[end + 1] <= 0xD7:
                break
            end += 2
        frame.scan = media[at:end]
        if media[end + 1] != 0xD9:
            raise ValueError("only files of one interleaved scan are supported")
        at = end + 2
        out.append(frame)
    return out


def _lanes(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Unstuffed bytes of a scan, and where its restart segments start."""
    data = np.frombuffer(scan, np.uint8)
    mark = np.flatnonzero(data[:-1] == 255) if len(data) > 1 else np.zeros(0, np.int64)
    follow = data[mark + 1]
    stuffed, restart = mark[follow == 0] + 1, mark[follow >= 0xD0]
    keep = np.ones(len(data), bool)
    keep[stuffed] = keep[restart] = keep[restart + 1] = False
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], np.concatenate(([0], kept_before[restart + 2]))


def _decode(frames: list[Frame]) -> list[np.ndarray]:
    """DC coefficients of the luminance, as numbers of the MCU order, for frames of one MCU layout. All restart segments advance in step."""
    layout = frames[0].mcu()
    tables: dict[tuple, int] = {}
    for f in frames:
        for c in f.parts:
            for k in ("dc", "ac"):
                tables.setdefault(c[k], len(tables))
    look = np.concatenate([_lookup(*map(list, t)) for t in tables])
    data, begin, count, of, dc_at, ac_at, at = [], [], [], [], [], [], 0
    for i, f in enumerate(frames):
        d, starts = _lanes(f.scan)
        cols, high = f.mcus()
        total = cols * high
        per = f.interval or total
        data += [d, np.full(8, 255, np.uint8)]  # each file is followed by what a decoder may look ahead into
        begin.append(starts + at)
        at += len(d) + 8
        if len(starts) != -(-total // per):
            raise ValueError("restart markers do not match the restart interval")
        count.append(np.minimum(per, total - per * np.arange(len(starts))))
        of.append(np.full(len(starts), i))
        dc_at.append(np.tile([tables[c["dc"]] << 16 for c in f.parts], (len(starts), 1)))
        ac_at.append(np.tile([tables[c["ac"]] << 16 for c in f.parts], (len(starts), 1)))
    raw = np.concatenate([*data, np.full(8, 255, np.uint8)]).astype(np.uint32)
    # Every byte with the three behind it, so that one gather gives 25 bits from any bit on.
    ahead = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    bit, left, of = np.concatenate(begin) * 8, np.concatenate(count), np.concatenate(of)
    dc_at, ac_at = np.concatenate(dc_at), np.concatenate(ac_at)
    order = np.argsort(-left, kind="stable")  # lanes that end first come last
    bit, left, dc_at, ac_at = bit[order], left[order], dc_at[order], ac_at[order]
    luma = [j for j, c in enumerate(layout) if c == 0]
    steps = int(left.max())
    out = np.zeros((len(bit), steps * len(luma)), np.int32)
    last = np.zeros((len(frames[0].parts), len(bit)), np.int32)
    alive = np.searchsorted(-left, -np.arange(steps), side="left")  # lanes with more than so many MCUs
    limit = 8 * (len(ahead) - 1)

    def peek(b):
        return (ahead[b >> 3] << (b & 7).astype(np.uint32)) >> np.uint32(16)

    for m in range(steps):
        n = int(alive[m])
        at = 0
        for j, part in enumerate(layout):
            b = bit[:n]
            found = look[dc_at[:n, part] + peek(b)]
            length, size = (found >> 8).astype(np.int64), (found & 255).astype(np.int64)
            if not length.all():
                raise ValueError("a code that no table has")
            b = b + length
            extra = peek(b).astype(np.int32) >> (16 - size).astype(np.int32)
            value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
            last[part, :n] += value.astype(np.int32)
            b = b + size
            if luma and part == 0:
                out[:n, m * len(luma) + at] = last[0, :n]
                at += 1
            k, on = np.ones(n, np.int64), slice(0, n)
            first = True
            while True:
                here = b if first else b[on]
                found = look[(ac_at[:n, part] if first else ac_at[on, part]) + peek(here)]
                length, run, size = (found >> 8).astype(np.int64), (found >> 4 & 15).astype(np.int64), (found & 15).astype(np.int64)
                if not length.all() or here.max(initial=0) > limit:
                    raise ValueError("a code that no table has")
                moved, ended = here + length + size, (found & 255) == 0
                if first and ended.all():
                    b = moved
                    break
                b[on] = moved
                k[on] = np.where(ended, 64, k[on] + run + 1)
                on, first = np.flatnonzero(k < 64), False
                if not len(on):
                    break
            bit[:n] = b
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out, left = out[back], left[back]
    result = []
    for i in range(len(frames)):
        own = np.flatnonzero(of == i)
        result.append(np.concatenate([out[x, : left[x] * len(luma)] for x in own]) if len(np.unique(left[own])) > 1 else out[own, : left[own[0]] * len(luma)].ravel())
    return result


def thumbnail(frame: Frame, dc: np.ndarray) -> np.ndarray:
    """Luminance, one pixel a block, in 0 to 255."""
    cols, high = frame.mcus()
    h, v = (frame.parts[0]["h"], frame.parts[0]["v"]) if len(frame.parts) > 1 else (1, 1)
    grid = dc.reshape(high, cols, v, h).transpose(0, 2, 1, 3).reshape(high * v, cols * h)
    wide, rows = frame.luma_blocks
    if len(frame.parts) > 1:  # the luminance may itself be sampled down
        wide, rows = (-(-x * frame.parts[0][k] // max(c[k] for c in frame.parts)) for x, k in ((wide, "h"), (rows, "v")))
    value = np.floor_divide(grid[:rows, :wide] * frame.parts[0]["q"] + 4, 8) + 128
    return np.clip(value, 0, 255).astype(np.uint8)


def dc_thumbnails(media: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each value its files' frames and thumbnails. Files of one layout are decoded together, some at a time."""
    frames = [parse(m) for m in media]
    out: list[list] = [[None] * len(f) for f in frames]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, own in enumerate(frames):
        for j, f in enumerate(own):
            groups.setdefault((tuple(f.mcu()), len(f.parts), f.interval), []).append((i, j))
    for own in groups.values():
        at = 0
        while at < len(own):
            part, size = [], 0
            while at < len(own) and (not part or size + len(frames[own[at][0]][own[at][1]].scan) <= 2 * AT_A_TIME):
                part.append(own[at])
                size += len(frames[own[at][0]][own[at][1]].scan)
                at += 1
            for (i, j), dc in zip(part, _decode([frames[i][j] for i, j in part])):
                out[i][j] = (frames[i][j], thumbnail(frames[i][j], dc))
    return out


def feature(files: list[tuple[Frame, np.ndarray]]) -> str:
    """Dimensions of the first file, and the thumbnail hash: a bit for each of 8 x 8 areas, set if lighter than the areas' mean, of all files on top of each other."""
    frame = files[0][0]
    sums, n = np.zeros((8, 8)), np.zeros((8, 8))
    for _, t in files:
        y, x = np.arange(t.shape[0]) * 8 // t.shape[0], np.arange(t.shape[1]) * 8 // t.shape[1]
        rows = np.zeros((8, t.shape[1]))
        np.add.at(rows, y, t)
        sums += np.stack([np.bincount(x, r, 8) for r in rows])
        n += np.outer(np.bincount(y, minlength=8), np.bincount(x, minlength=8))
    mean = np.divide(sums, n, out=np.zeros_like(sums), where=n > 0)
    return f"{frame.width}x{frame.height}:{int(np.packbits(mean.ravel() > mean.mean()).view('>u8')[0]):016x}"


def media_column(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: every whole text as JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in _portions([len(x or "") for x in texts]):
                raw = [payload(x) for x in texts[i:j]]
                n = [len((x or "").encode("utf-8", "surrogatepass")) for x in texts[i:j]]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(encode_payloads(raw), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes add up to AT_A_TIME at most; a larger one is alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > AT_A_TIME:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def media_features(media: DataFrame) -> DataFrame:
    """media: doc_id, n_bytes, media. Decodes the stored bytes; doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stored = b.column(2).to_pylist()
            for i, j in _portions([len(x) for x in stored]):
                part, rows = stored[i:j], []
                for m, files in zip(part, dc_thumbnails(part)):
                    raw = b"".join(t.tobytes() for _, t in files)
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(files), files[0][0].width, sum(f.height for f, _ in files)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def stored(media: DataFrame, path: str) -> DataFrame:
    """media_column's rows, written to a new folder ``path`` that all executors reach, and read from there."""
    media.write.parquet(path, compression="zstd")
    return media.sparkSession.read.schema(media.schema).parquet(path)


def op5_jpeg(spark, sf_dir: str) -> DataFrame:
    return media_features(stored(media_column(documents(spark, sf_dir)), fresh_dir(spark, "media")))


SQL: dict[str, str] = {}
QUERIES = {"op5_jpeg": op5_jpeg}
