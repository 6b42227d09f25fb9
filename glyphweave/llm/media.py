"""Media columns: ISO base media containers read without decoding their payloads.

Boxes are walked as a tree (64-bit and to-the-end sizes included), the sample tables (stts, stsc, stsz or stz2, stco or
co64, stss) are decoded with numpy, and fragments (moof with tfhd and trun over trex defaults) are added to them. For
each track: kind, codec, timescale, duration, number of samples and the byte ranges of its keyframes.

Defined results: a null or empty value gives one row with error "empty"; what is no container, is cut off within its
index or has tables that contradict each other or claim more than a file of its size can hold gives one row with the
error named; a duration that the header leaves open is null. A track without stss has keyframes
only. A container without tracks gives one row with error "no track". Repeated rows are read each on their own; ties
can't arise. Other columns are ignored unless named in keep; clashing names are replaced. An empty table gives an empty
table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = [("track_id", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("key_start", pa.list_(pa.int64())), ("key_end", pa.list_(pa.int64())), ("error", pa.string())]
KINDS = "track_id long, kind string, codec string, timescale long, duration long, samples long, key_start array<long>, key_end array<long>, error string"
_INSIDE = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf", b"edts", b"dinf"}


class Broken(ValueError):
    pass


def boxes(m: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, box start, payload start, end) of the boxes in a range."""
    while at < end:
        if end - at < 8:
            raise Broken("cut off in a box header")
        size, kind = struct.unpack_from(">I4s", m, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Broken("cut off in a box header")
            size, head = struct.unpack_from(">Q", m, at + 8)[0], 16
        stop = end if size == 0 else at + size
        if size and size < head:
            raise Broken("a box smaller than its header")
        if stop > end:
            if kind != b"mdat":  # a payload that is cut off leaves the index readable
                raise Broken(f"cut off in {kind.decode('latin-1')}")
            stop = end
        yield kind, at, at + head, stop
        at = stop


def _table(m: memoryview, at: int, end: int, kind: str, columns: int = 1, skip: int = 8) -> np.ndarray:
    if end - at < skip:
        raise Broken("cut off in a table")
    n = struct.unpack_from(">I", m, at + skip - 4)[0]
    size = np.dtype(kind).itemsize * columns
    if at + skip + n * size > end:
        raise Broken("a table longer than its box")
    t = np.frombuffer(m[at + skip : at + skip + n * size], kind).astype(np.int64)
    return t.reshape(-1, columns) if columns > 1 else t


class Bounds:
    """What a file's tables may claim: samples that take no room in a table can't outnumber the file's bytes, and sums stay
    within 62 bits. So no array grows beyond the file, whatever its fields say."""

    def __init__(self, size: int):
        self.left = size

    def claim(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise Broken("more samples than bytes")
        return n

    @staticmethod
    def fits(x: int | float) -> None:
        if not 0 <= x < 1 << 62:
            raise Broken("a number out of range")


def _total(count: np.ndarray, each: np.ndarray) -> int:
    Bounds.fits(float((count.astype(float) * each).sum()))
    return int((count * each).sum())


def _samples(m: memoryview, t: dict, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(keyframe offsets, keyframe sizes, samples, duration) from the sample tables of a track. Places are found for
    keyframes only, so equal sizes are never spread over the samples."""
    size, fixed, n = np.zeros(0, np.int64), 0, 0
    if "stsz" in t:
        a, b = t["stsz"]
        if b - a < 12:
            raise Broken("cut off in a table")
        fixed, n = struct.unpack_from(">II", m, a + 4)
        if not fixed:
            size = _table(m, a, b, ">u4", 1, 12)
    elif "stz2" in t:
        a, b = t["stz2"]
        if b - a < 12:
            raise Broken("cut off in a table")
        width, n = m[a + 7], struct.unpack_from(">I", m, a + 8)[0]
        if width == 4:
            if a + 12 + (n + 1) // 2 > b:
                raise Broken("a table longer than its box")
            raw = np.frombuffer(m[a + 12 : a + 12 + (n + 1) // 2], np.uint8)
            size = np.column_stack([raw >> 4, raw & 15]).ravel()[:n].astype(np.int64)
        else:
            size = _table(m, a, b, ">u2" if width == 16 else ">u1", 1, 12)
    Bounds.fits(fixed * n)
    chunk = _table(m, *t["co64"], ">u8") if "co64" in t else _table(m, *t["stco"], ">u4") if "stco" in t else np.zeros(0, np.int64)
    runs = _table(m, *t["stsc"], ">u4", 3) if "stsc" in t else np.zeros((0, 3), np.int64)
    times = _table(m, *t["stts"], ">u4", 2) if "stts" in t else np.zeros((0, 2), np.int64)
    duration = _total(times[:, 0], times[:, 1])
    if "stss" in t:
        keys = _table(m, *t["stss"], ">u4") - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= max(n, 1)):
            raise Broken("a keyframe beyond the samples")
    else:
        keys = np.arange(bounds.claim(n))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0, duration
    if not len(chunk) or not len(runs):
        raise Broken("samples without chunks")
    if chunk.min() < 0 or chunk.max() >= 1 << 62:
        raise Broken("a number out of range")
    steps = np.diff(np.append(runs[:, 0], len(chunk) + 1))
    if runs[0, 0] != 1 or steps.min() < 0 or (last := np.cumsum(per := np.repeat(runs[:, 1], steps)))[-1] < n:
        raise Broken("sample tables contradict each other")
    of = np.searchsorted(last, keys, side="right")  # each keyframe's chunk
    first = last[of] - per[of]
    if fixed:
        return chunk[of] + (keys - first) * fixed, np.full(len(keys), fixed, np.int64), n, duration
    before = np.concatenate(([0], np.cumsum(size)))
    return chunk[of] + before[keys] - before[first], size[keys], n, duration


def _track(m: memoryview, at: int, end: int, depth: int = 0) -> dict:
    """Places of the boxes of a trak, by name."""
    if depth > 8:
        raise Broken("boxes nested too deep")
    t: dict = {}
    for kind, _, a, b in boxes(m, at, end):
        if kind in _INSIDE:
            t |= _track(m, a, b, depth + 1)
        else:
            t[kind.decode("latin-1")] = (a, b)
    return t


def _fragment(m: memoryview, moof: int, a: int, b: int, trex: dict[int, tuple], out: dict, bounds: Bounds) -> None:
    tid, base, after = 0, moof, None
    size0 = dur0 = flags0 = 0
    for kind, _, x, y in boxes(m, a, b):
        if kind == b"tfhd":
            flags, tid = struct.unpack_from(">II", m, x)
            flags &= 0xFFFFFF
            dur0, size0, flags0 = trex.get(tid, (0, 0, 0))
            p = x + 8
            if flags & 1:
                base, p = struct.unpack_from(">Q", m, p)[0], p + 8
            p += 4 * bool(flags & 2)
            if flags & 8:
                dur0, p = struct.unpack_from(">I", m, p)[0], p + 4
            if flags & 16:
                size0, p = struct.unpack_from(">I", m, p)[0], p + 4
            if flags & 32:
                flags0 = struct.unpack_from(">I", m, p)[0]
        elif kind == b"trun":
            flags, n = struct.unpack_from(">II", m, x)
            flags &= 0xFFFFFF
            p = x + 8
            start = base if after is None else after
            if flags & 1:
                start, p = base + struct.unpack_from(">i", m, p)[0], p + 4
            first = None
            if flags & 4:
                first, p = struct.unpack_from(">I", m, p)[0], p + 4
            names = [k for k, bit in (("d", 0x100), ("s", 0x200), ("f", 0x400), ("c", 0x800)) if flags & bit]
            if p + 4 * n * len(names) > y:
                raise Broken("a table longer than its box")
            if not names:
                bounds.claim(n)
            rows = np.frombuffer(m[p : p + 4 * n * len(names)], ">u4").astype(np.int64).reshape(n, len(names)) if names else np.zeros((n, 0), np.int64)
            col = {k: rows[:, i] for i, k in enumerate(names)}
            size = col.get("s", np.full(n, size0, np.int64))
            dur = col.get("d", np.full(n, dur0, np.int64))
            fl = col.get("f", np.full(n, flags0, np.int64)).copy()
            if first is not None and n:
                fl[0] = first
            one = np.ones(n, np.int64)
            Bounds.fits(start), Bounds.fits(after := start + _total(one, size))
            off = start + np.cumsum(size) - size
            keys = np.flatnonzero(fl & 0x10000 == 0)
            out.setdefault(tid, []).append((off[keys], size[keys], n, _total(one, dur)))


def _probe(m: memoryview) -> list[tuple]:
    """A row of FIELDS for each track, keyframe ranges as arrays."""
    tracks, trex, frags, bounds = [], {}, {}, Bounds(len(m))
    for kind, start, a, b in boxes(m, 0, len(m)):
        if kind == b"moov":
            for k, _, x, y in boxes(m, a, b):
                if k == b"trak":
                    tracks.append(_track(m, x, y))
                elif k == b"mvex":
                    for k2, _, u, _v in boxes(m, x, y):
                        if k2 == b"trex":
                            tid, _, d, s, f = struct.unpack_from(">5I", m, u + 4)
                            trex[tid] = (d, s, f)
        elif kind == b"moof":
            for k, _, x, y in boxes(m, a, b):
                if k == b"traf":
                    _fragment(m, start, x, y, trex, frags, bounds)
    if not tracks:
        raise Broken("no track")
    out, seen = [], set()
    for t in tracks:
        if not {"tkhd", "mdhd", "hdlr", "stsd"} <= t.keys():
            raise Broken("a track without its headers")
        a = t["tkhd"][0]
        tid = struct.unpack_from(">I", m, a + (20 if m[a] else 12))[0]
        if tid in seen:
            raise Broken("two tracks of one id")
        seen.add(tid)
        a = t["mdhd"][0]
        scale, length = struct.unpack_from(">IQ", m, a + 20) if m[a] else struct.unpack_from(">II", m, a + 12)
        a = t["hdlr"][0]
        kind = bytes(m[a + 8 : a + 12]).decode("latin-1")
        a, b = t["stsd"]
        codec = bytes(m[a + 12 : a + 16]).decode("latin-1") if b - a >= 16 else None
        off, size, n, dur = _samples(m, t, bounds)
        own = [(off, size, n, dur), *frags.get(tid, [])]
        n, dur = sum(x[2] for x in own), sum(x[3] for x in own) or length
        starts, sizes = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
        out.append((tid, kind, codec, scale, dur if dur < 1 << 63 else None, n, starts, starts + sizes, None))  # all bits set: not known
    return out


def probe(data: bytes | memoryview | None) -> list[tuple]:
    """A row of FIELDS for each track, or one with an error."""
    if not data:
        why = "empty"
    else:
        try:
            return _probe(memoryview(data))
        except Broken as e:
            why = str(e)
        except (struct.error, IndexError):
            why = "cut off in a header"
        except (ValueError, OverflowError):
            why = "a number out of range"
    return [(None,) * (len(FIELDS) - 1) + (why,)]


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(samples: list[bytes], durations: list[int], codec: str, gop: int = 12, per_chunk: int = 8, timescale: int = 1000, wide: bool = False, index_first: bool = False) -> bytes:
    """A container of one video track whose every gop-th sample is a keyframe: the writer that tests and the query use."""
    n = len(samples)
    size = np.array([len(s) for s in samples], np.int64)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    payload = b"".join(samples)
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload if wide else _box(b"mdat", payload)
    head = len(mdat) - len(payload)
    d = np.array(durations, np.int64)
    cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if n else np.zeros(0, np.int64)
    stts = np.column_stack([np.diff(np.append(cut, n)), d[cut]]) if n else np.zeros((0, 2), np.int64)
    chunks, rest = -(-n // per_chunk), n % per_chunk
    stsc = [(1, per_chunk, 1)] if n >= per_chunk else []
    if rest:
        stsc.append((chunks, rest, 1))

    def moov(base: int) -> bytes:
        at = base + (np.cumsum(size) - size)[::per_chunk]
        table = lambda a, kind: struct.pack(">I", len(a)) + np.asarray(a).astype(kind).tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(codec.encode("latin-1"), bytes(78))),
            _full(b"stts", table(stts, ">u4")),
            _full(b"stss", table(np.arange(1, n + 1, gop), ">u4")),
            _full(b"stsc", table(np.array(stsc, np.int64).reshape(-1, 3), ">u4")),
            _full(b"stsz", struct.pack(">I", 0), table(size, ">u4")),
            _full(b"co64", table(at, ">u8")) if wide else _full(b"stco", table(at, ">u4")),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, int(d.sum()), 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(13)), minf)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, timescale, int(d.sum())), bytes(80)), _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, int(d.sum())), bytes(60), flags=3), mdia))

    if index_first:
        size_moov = len(moov(0))
        return ftyp + moov(len(ftyp) + size_moov + head) + mdat
    return ftyp + mdat + moov(len(ftyp) + head)


def read_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., track_id, kind, codec, timescale, duration, samples, key_start, key_end, error): a row for each track.
    One narrow pass; payload bytes are never decoded nor copied."""
    names = [n for n, _ in FIELDS]
    kept = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []
            for i, x in enumerate(b.column(b.num_columns - 1)):
                got = probe(memoryview(x.as_buffer()) if x.is_valid else None)
                rows += got
                of += [i] * len(got)
            cols = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            ids = [c.take(pa.array(of, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, (_, k) in zip(cols, FIELDS, strict=True))], names=[*kept, *names])

    d = df.select(*[F.col(f"`{c}`") for c in kept], F.col(media_col).alias("_media"))
    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], *T._parse_datatype_string(KINDS).fields]))


CODECS = {"en": "avc1", "fr": "hvc1", "de": "av01", "es": "vp09"}


def captioned(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the tables here hold no media, so each document becomes a container whose samples are its lines,
    shown for 500 ticks and 10 for each character, with the codec named after its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if text is None:
                    out.append(None)
                    continue
                lines = text.split("\n")
                out.append(mux([x.encode("utf-8", "surrogatepass") for x in lines], [500 + 10 * len(x) for x in lines], CODECS.get(lang, "mp4v")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, media binary")
