"""Against a plain LZW coder and hand-made files, and an exact round trip."""

import hashlib
import random
import struct
import zlib

import numpy as np

from kvframe.llm import gif, queries


def coded(index, least, clear_at=4096):
    """A plain variable-width LZW coder."""
    clear, bits = 1 << least, []
    width, table = least + 1, {}

    def put(code):
        bits.extend(code >> k & 1 for k in range(width))

    def start():
        nonlocal width, table
        width, table = least + 1, {bytes([k]): k for k in range(clear)}

    start()
    put(clear)
    free, held = clear + 2, b""
    for v in index:
        more = held + bytes([v])
        if more in table:
            held = more
            continue
        put(table[held])
        if free < min(4096, clear_at):
            table[more] = free
            free += 1
            if free == (1 << width) + 1 and width < 12:
                width += 1
        else:
            put(clear)
            start()
            free = clear + 2
        held = bytes([v])
    if held:
        put(table[held])
        free += 1
        if free == (1 << width) + 1 and width < 12:
            width += 1
    put(clear + 1)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def blocks(stream):
    return b"".join(bytes([len(stream[a : a + 255])]) + stream[a : a + 255] for a in range(0, len(stream), 255)) + b"\0"


def image(index, w, h, left=0, top=0, least=2, delay=3, disposal=0, clear=None, flags=0, local=b""):
    packed = disposal << 2 | (clear is not None)
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", packed, delay, clear or 0, 0)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + bytes([least]) + blocks(coded(index, least))


def movie(w, h, *images, palette=bytes(range(0, 120, 10))):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette + b"\x21\xfe\x02hi\0" + b"".join(images) + b"\x3b"


def test_lzw_like_the_plain_coder():
    rng = random.Random(1)
    streams, leasts, pixels, want = [], [], [], []
    for least in (2, 3, 5, 8):
        for n in (1, 2, 30, 577, 9000):
            for kinds in (1, 2, 1 << least):
                index = bytes(rng.randrange(kinds) for _ in range(n))
                streams.append(coded(index, least, rng.choice([4096, 300 + (1 << least)])))
                leasts.append(least)
                pixels.append(n)
                want.append(index)
    assert [x.tobytes() for x in gif.lzw(streams, leasts, pixels)] == want


def test_hostile_files():
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + image([0], 65535, 65535) + b"\x3b"
    many = movie(4000, 4000, *[image([1], 1, 1)] * 40)
    bomb = movie(2, 2, image([1] * 9000, 2, 2))
    assert gif.decode([huge, many])[0] == "too many pixels" == gif.decode([many])[0]
    assert gif.decode([bomb])[0].frames.shape == (1, 2, 2, 3)


def test_stored_streams_use_the_table():
    data = b"the cat and the dog and the cat " * 18
    codes, count = gif.codes_of(np.frombuffer(data, np.uint8)[None])
    assert codes.max() > 300 and count[0] < len(data) / 3
    assert len(gif.text_to_gif(data)) < 800 + 400 and gif.decode([gif.text_to_gif(data)])[0].frames[..., 0].tobytes() == data


def test_disposal_transparency_and_palettes():
    p = np.arange(0, 120, 10, dtype=np.uint8).reshape(4, 3)
    data = movie(
        4, 2,
        image([1] * 8, 4, 2, disposal=1),
        image([2, 3], 2, 1, 1, 0, clear=3, disposal=2),
        image([3], 1, 1, 3, 1, disposal=3),
        image([0], 1, 1, 0, 0, flags=0x80, local=bytes([200] * 6)),
    )
    got = gif.decode([data])[0]
    base = np.tile(p[1], (2, 4, 1))
    first = base.copy()
    second = base.copy()
    second[0, 1] = p[2]
    third = base.copy()
    third[0, 1:3] = 0
    fourth = third.copy()
    third[1, 3] = p[3]
    fourth[0, 0] = 200
    assert np.array_equal(got.frames, np.stack([first, second, third, fourth]))
    assert got.delays == [3] * 4 and not got.drawn[2, 0, 1] and got.drawn[1].all()


def test_interlaced():
    rows = [[r % 4] * 3 for r in range(10)]
    order = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    got = gif.decode([movie(3, 10, image(sum((rows[r] for r in order), []), 3, 10, flags=0x40))])[0]
    assert got.frames[0, :, 0, 0].tolist() == [30 * (r % 4) for r in range(10)]


def test_frames_table(spark):
    good = movie(2, 1, image([1, 2], 2, 1), image([3, 3], 2, 1))
    rows = [(1, good, 0), (2, None, 0), (3, b"junk", 0), (4, good[:40], 0), (1, good, 0)]
    got = gif.gif_frames(spark.createDataFrame(rows, "doc_id long, media binary, frame int")).collect()
    assert sorted((r.doc_id, r.frame, r.at_cs) for r in got if not r.error) == [(1, 0, 0), (1, 0, 0), (1, 1, 3), (1, 1, 3)]
    assert {r.doc_id for r in got if r.error} == {2, 3, 4} and all(sum(r.histogram) == 2 for r in got if not r.error)
    assert gif.gif_frames(spark.createDataFrame([], "doc_id long, media binary")).collect() == []


def test_round_trip(spark):
    for n in (0, 1, 575, 576, 577, 5000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        frames = gif.decode([gif.text_to_gif(data)])[0].frames
        assert frames[..., 0].tobytes() == data.ljust(max(1, -(-n // 576)) * 576, b"\xff")
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in queries.documents(spark, sf).collect()}
    got = queries.op4_gif(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id]
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(gif.text_to_gif(raw)).hexdigest()
    empty = gif.store_and_read(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_bytes, r.payload_bytes) for r in empty] == [(None, 0, 576)]
