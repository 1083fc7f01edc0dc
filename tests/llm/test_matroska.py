import random

import pytest

from tessera.llm import matroska as m


@pytest.mark.parametrize("kind", ["xiph", "fixed", "ebml"])
def test_round_trip_under_each_lacing(kind):
    rng = random.Random(1)
    for size in (0, 1, 575, 576, 577, 576 * 8, 576 * 9 + 5, 600_000):
        raw = m.payload(rng.randbytes(size))
        assert len(raw) % 576 == 0 and len(raw) >= 576 and raw[size:] == b"\xff" * (len(raw) - size)
        media = m.write_pcm(raw, kind)
        got, back = m.read_back(media)
        assert back == raw
        assert [p[1] for p in got.packets] == [k * m.FRAME_NS for k in range(len(raw) // 576)]
        assert got.tracks[1]["codec"] == "A_PCM/INT/LIT" and got.tracks[1]["depth"] == 8
        for time, track, at in got.cues:
            assert track == 1 and int.from_bytes(media[at : at + 4], "big") == m.CLUSTER
            assert any(p[1] == time for p in got.packets)


def test_laces_of_uneven_frames():
    rng = random.Random(2)
    for kind in ("xiph", "ebml"):
        frames = [rng.randbytes(n) for n in (0, 1, 254, 255, 256, 510, 20000, 3, 3)]
        body = m.lace(frames, kind)
        found = m._frames(body, 0, len(body), m.LACINGS.index(kind))
        assert [body[s:e] for s, e in found] == frames


def test_unknown_sizes_groups_and_unknown_elements():
    cluster = lambda t, f: b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + m.unsigned(m.TIMESTAMP, t) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(1, -2, [f], "none")) + m.element(0xFB, b"\x01"))
    body = m._INFO + m._TRACKS + m.element(0xEC, b"void") + cluster(10, b"one") + cluster(20, b"two")
    got = m.parse(m._HEAD + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + body)
    assert [(p[1], p[4], p[6]) for p in got.packets] == [(8_000_000, 0, False), (18_000_000, 1, False)]


def test_damage_is_an_error():
    media = m.write_pcm(m.payload(b"x" * 5000))
    for bad in (media[:-1], media[:50], m._HEAD + m.element(m.SEGMENT, m._TRACKS + m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, m.vint(1) + b"\0\0\x02\x01\xff\xff")))):
        with pytest.raises(ValueError):
            m.parse(bad)
    with pytest.raises(ValueError):
        m.write_pcm(b"abc")


def test_query_columns(spark):
    docs = spark.createDataFrame([(1, "héllo"), (2, None), (3, ""), (4, "x" * 30000), (4, "x" * 30000)], "doc_id long, text string")
    rows = m.media_features(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and by[1].n_bytes == 6 and by[1].payload_bytes == 576
    assert by[2].payload_sha256 == by[3].payload_sha256 and by[2].feature == by[3].feature
    packets = m.packet_table(m.encode_column(docs)).where("doc_id = 4").collect()
    assert len(packets) == 2 * 53 and {p.lacing for p in packets} == {"fixed"}
    assert m.media_features(docs.limit(0)).count() == 0
