import hashlib
import tarfile
import zlib

import pytest

from carrel.llm import media as m


@pytest.mark.parametrize("text", [None, "", "a", "é" * 288, "x" * 576, "x" * 577, "\0\xff"])
def test_round_trip(text):
    p = m.payload(text)
    assert len(p) % 576 == 0 and len(p) >= 576 and p.rstrip(b"\xff") == (text or "").encode()
    image = m.encode(p)
    assert m.decode(image) == p and m.header(image[:33])[:2] == (576, len(p) // 576)
    with pytest.raises(ValueError):
        m.decode(image[:50] + b"~" + image[51:])


def test_store(spark, docs, empty, tmp_path):
    index, folder = m.store_media(docs, f"file://{tmp_path}/media", shard_bytes=4096)
    rows = m.media_features(index, folder).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    assert len(rows) == docs.count()
    for r in rows:
        p = m.payload(texts[r.doc_id])
        assert r.digest == r.payload_sha256 == hashlib.sha256(p).hexdigest()
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(p), zlib.crc32(p[-32:]))
        assert r.media_bytes == r.length and r.media_sha256 == hashlib.sha256(m.encode(p)).hexdigest()
    by = {r.doc_id: r for r in rows}
    assert by[2].feature == by[3].feature and by[1].media_sha256 == by[4].media_sha256
    meta = {r.doc_id: (r.width, r.height, r.bits) for r in m.media_metadata(index, folder).collect()}
    assert meta[6] == (576, by[6].payload_bytes // 576, 8)
    shard = tarfile.open(f"{tmp_path}/media/{by[6].shard}")
    member = shard.getmember(f"{by[6].digest}.png")
    assert (member.offset_data, member.size) == (by[6].offset, by[6].length)
    names = shard.getnames()
    assert len(names) == len(set(names))
    index, folder = m.store_media(empty, f"file://{tmp_path}/none")
    assert m.media_features(index, folder).count() == 0
