import random
import struct
import tracemalloc

import pytest
from edges import clashing, edges, empty

from glyphweave.llm import media as M


def row(data):
    return [dict(zip([n for n, _ in M.FIELDS], r)) for r in M.probe(data)]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("n", [0, 1, 8, 29])
def test_round_trip(wide, first, n):
    samples = [bytes([65 + i]) * (i * 7 % 11) for i in range(n)]
    data = M.mux(samples, [100 + i // 3 for i in range(n)], "avc1", gop=5, per_chunk=4, wide=wide, index_first=first)
    (r,) = row(data)
    assert r["codec"] == "avc1" and r["kind"] == "vide" and r["samples"] == n and r["error"] is None
    assert r["duration"] == sum(100 + i // 3 for i in range(n))
    assert [data[a:b] for a, b in zip(r["key_start"], r["key_end"], strict=True)] == samples[::5]


def test_broken_containers():
    data = M.mux([b"abc"] * 20, [10] * 20, "hvc1")
    assert row(None)[0]["error"] == row(b"")[0]["error"] == "empty"
    assert row(b"not a container at all")[0]["error"]
    assert row(M._box(b"ftyp", b"isom"))[0]["error"] == "no track"
    for cut in range(1, len(data)):
        assert row(data[:cut])[0]["error"]
    bad = data.replace(b"stsz" + bytes(8) + struct.pack(">I", 20), b"stsz" + bytes(8) + struct.pack(">I", 2000000))
    assert row(bad)[0]["error"] == "a table longer than its box"


def test_small_sizes_and_all_sync():
    data = M.mux([b"ab", b"c", b"defg"], [1, 1, 1], "mp4a")
    sizes = struct.pack(">III", 0, 8, 3) + bytes([2, 1, 4])
    old = M._full(b"stsz", struct.pack(">II", 0, 3), struct.pack(">III", 2, 1, 4))
    new = M._full(b"stz2", struct.pack(">II", 8, 3), bytes([2, 1, 4]), bytes(len(old) - 12 - 8 - 3))
    (r,) = row(data.replace(old, new))
    assert sizes and r["samples"] == 3
    (r,) = row(data.replace(b"stss", b"free"))
    assert [data[a:b] for a, b in zip(r["key_start"], r["key_end"])] == [b"ab", b"c", b"defg"]


def test_fragments():
    init = M.mux([], [], "avc1", index_first=True)
    moov_at = init.index(b"moov") - 4
    mvex = M._box(b"mvex", M._full(b"trex", struct.pack(">IIIII", 1, 1, 40, 0, 0x10000)))
    size = struct.unpack_from(">I", init, moov_at)[0]
    init = init[:moov_at] + struct.pack(">I", size + len(mvex)) + init[moov_at + 4 : moov_at + size] + mvex + init[moov_at + size :]
    samples = [b"key", b"between", b"more"]

    def moof(offset):
        run = M._full(b"trun", struct.pack(">IiI", 3, offset, 0), b"".join(struct.pack(">I", len(s)) for s in samples), flags=0x205)
        return M._box(b"moof", M._full(b"mfhd", bytes(4)), M._box(b"traf", M._full(b"tfhd", struct.pack(">I", 1), flags=0x20000), run))

    one = moof(len(moof(0)) + 8) + M._box(b"mdat", b"".join(samples))
    data = init + one + one
    (r,) = row(data)
    assert r["samples"] == 6 and r["duration"] == 240 and [data[a:b] for a, b in zip(r["key_start"], r["key_end"])] == [b"key", b"key"]


def test_edges(spark):
    d = clashing(edges(spark))
    got = M.read_media(M.captioned(d)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[2].error == "empty" and by[2].track_id is None and by[3].samples == 1 and by[3].duration == 500
    assert by[6].samples == 2 and by[6].codec == "mp4v" and by[None].codec == "hvc1"
    assert M.read_media(M.captioned(empty(spark))).count() == 0
    extra = spark.createDataFrame([(1, bytearray(b"junk junk"), 5)], "doc_id long, media binary, error int")
    assert M.read_media(extra).first().error.startswith("cut off in")


def fragmented():
    """A container with every kind of box that is read: tables in two widths, fragments with and without fields."""
    init = M.mux([b"ab", b"c", b"defg"] * 7, [3] * 21, "avc1", gop=4, index_first=True, wide=True)
    at = init.index(b"moov") - 4
    size = struct.unpack_from(">I", init, at)[0]
    mvex = M._box(b"mvex", M._full(b"trex", struct.pack(">IIIII", 1, 1, 40, 5, 0x10000)))
    init = init[:at] + struct.pack(">I", size + len(mvex)) + init[at + 4 : at + size] + mvex + init[at + size :]
    runs = M._full(b"trun", struct.pack(">IiI", 2, 8, 0), struct.pack(">II", 3, 4), flags=0x205) + M._full(b"trun", struct.pack(">I", 2))
    head = M._full(b"tfhd", struct.pack(">IQIII", 1, 64, 7, 9, 0), flags=0x39)
    return init + M._box(b"moof", M._full(b"mfhd", bytes(4)), M._box(b"traf", head, runs)) + M._box(b"mdat", bytes(25))


def test_corrupted_bytes_give_rows_and_take_little_memory():
    rng = random.Random(3)
    pcm = M.mux([b"xy"] * 40, [1] * 40, "sowt").replace(b"stss", b"free")
    old = M._full(b"stsz", struct.pack(">II", 0, 40), struct.pack(">I", 2) * 40)
    pcm = pcm.replace(old, M._full(b"stsz", struct.pack(">II", 2, 40), bytes(160)))
    whole = [M.mux([b"abc"] * 30, [10] * 30, "hvc1"), fragmented(), pcm]
    assert all(r[0]["error"] is None for r in map(row, whole)) and row(pcm)[0]["samples"] == 40 and row(whole[1])[0]["samples"] == 25
    tracemalloc.start()
    for k in range(20_000):
        data = bytearray(whole[k % 3])
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.choice((0, 1, 0x7F, 0x80, 0xF0, 0xFF, rng.randrange(256)))
        got = M.probe(bytes(data))
        assert got and all(len(r) == len(M.FIELDS) for r in got)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


@pytest.mark.parametrize("table, at, value", [("stsz", 4, 1), ("stsz", 8, 0xFFFFFFF0), ("stsc", 12, 0xFFFFFFF0), ("stsc", 8, 5), ("stts", 8, 0xFFFFFFF0), ("stco", 4, 0xFFFFFFF0), ("stss", 8, 0xFFFFFFF0)])
def test_huge_claims(table, at, value):
    data = bytearray(M.mux([b"abc"] * 20, [10] * 20, "hvc1"))
    where = data.index(table.encode()) + 4 + at
    data[where : where + 4] = struct.pack(">I", value)
    if table == "stsz":
        data[data.index(b"stsz") + 8 :][:4] = struct.pack(">I", 1)
    got = row(bytes(data))
    assert len(got) == 1 and (got[0]["error"] or got[0]["samples"] in (20, 0xFFFFFFF0))
