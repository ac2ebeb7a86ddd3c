import hashlib

import numpy as np

from panelforge.llm import media


def read_bit_by_bit(data):
    """A plain reader of eight-bit code streams."""
    out, at, width, table, before = [], 0, 9, [], None
    while True:
        code = sum((data[(at + k) >> 3] >> ((at + k) & 7) & 1) << k for k in range(width))
        at += width
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        text = table[code] if code < len(table) else before + before[:1]
        if before is not None and len(table) < 4096:
            table.append(before + text[:1])
        out.append(text)
        before = text
        if len(table) == 1 << width and width < 12:
            width += 1


def test_streams_are_compressed_and_plain_readers_agree():
    for n in (1, 63, 255, 256, 257, 1024, 9000, 30_000):
        for samples in (bytes(i * i * 7 >> 3 & 255 for i in range(n)), (b"ab" * n)[:n], (b"the quick brown fox, " * n)[:n]):
            stream = media.lzw_encode(samples)
            assert read_bit_by_bit(stream) == samples == media.lzw_decode(stream, 8, n).tobytes()
    assert len(media.lzw_encode(b"some words, again and again; " * 1000)) < 5000


def test_query_against_plain_counts(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "some words and more words " * 6000, "x" * 64]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in media.text_media(docs).collect()}
    for i, text in enumerate(texts):
        payload = (text or "").encode()
        payload += b"\0" * (-len(payload) % 64 or (0 if payload else 64))
        counts = [0] * 64
        for octet in payload:
            counts[16 * (octet & 3) + 4 * (octet >> 2 & 3) + (octet >> 4 & 3)] += 1  # the quarters of red, green and blue
        assert rows[i]["histogram"] == counts and rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert rows[i]["feature"] == bytes(c * 255 // len(payload) for c in counts).hex()
        assert rows[i]["n_frames"] == -(-len(payload) // 65536)
    assert rows[5]["media_bytes"] < rows[5]["payload_bytes"] / 4 and rows[4]["media_sha256"] == rows[6]["media_sha256"]
    assert media.text_media(docs.where("doc_id > 99")).count() == 0


def test_colours_tell_letters_apart():
    """Every bin of the histogram can be filled, the palette's colours are distinct, and unlike texts differ."""
    palette = np.frombuffer(media._PALETTE, np.uint8).reshape(-1, 3)
    assert len(np.unique(palette, axis=0)) == 256
    bins = media.histogram(palette.reshape(16, 16, 3))
    assert bins.tolist() == [4] * 64
    feature = lambda text: media.feature_of(sum(media.histogram(f.canvas) for f in media.decode(media.store_payload(text)[1])))
    made = [feature(t) for t in (b"abcdefgh" * 40, b"the quick brown fox " * 16, b"ABCDEFGH" * 40, b"xyz" * 107)]
    assert len(set(made)) >= 3 and len({c for c in made[1]}) > 2
