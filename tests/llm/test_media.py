import hashlib
import zlib

import numpy as np
import pytest

from tracewell.llm import media, queries

RNG = np.random.default_rng(3)
SAMPLES = [b"", b"a", b"aaa", b"ab" * 500, bytes(range(256)) * 40, b"\0" * 9000, RNG.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), RNG.integers(0, 3, 60_000, dtype=np.uint8).tobytes(), ("long text with words " * 9000).encode()]


@pytest.mark.parametrize("data", SAMPLES, ids=range(len(SAMPLES)))
def test_codecs(data):
    assert media.packbits_decode(media.packbits_encode(data, 64), len(data)) == data
    assert media.lzw_decode(media.lzw_encode(data), len(data)) == data


def test_known_streams():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media.packbits_decode(packed, 10**6) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)) + "0000000"
    assert media.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == int(codes, 2).to_bytes(11, "big")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files(order, compression, tiled, predictor):
    pages = [RNG.integers(0, 256, s, dtype=np.uint8) for s in ((1, 64), (300, 64), (130, 70, 3), (64, 64))]
    got = list(media.read_tiff(media.write_tiff(pages, compression, tiled, predictor, order)))
    assert [c for _, c in got] == [compression] * 4
    assert all((a.reshape(b.shape) == b).all() for (a, _), b in zip(got, pages, strict=True))


def test_texts_round_trip(spark):
    texts = [None, "", "x", "é" * 40, "y" * 64, "z" * 200_000, "same", "same"] + [f"text {i} " * 30 for i in range(20)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    files = media.store_texts(docs)
    assert {r.compression for r in media.tiff_pages(files).collect()} == {5, 8, 32773}
    rows = {r.doc_id: r for r in media.tiff_pages(files, keep=("doc_id", "n_bytes")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        assert rows[i].samples == raw.ljust(size, b"\0") and rows[i].n_bytes == len(raw) and rows[i].page == 0 and rows[i].error is None
    assert rows[6].feature == rows[7].feature


def test_query(spark):
    got = {r.doc_id: r for r in queries.op2_tiff(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        raw = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[d.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


def test_packbits_rows_are_packed_alone():
    data = bytes([5]) * 200
    assert media.packbits_encode(data, 64) == media.packbits_encode(data[:64], 64) * 3 + media.packbits_encode(data[:8], 64)


def test_headers_that_lie(spark):
    """Any single byte of a header changed, sizes of 0 and of billions: rows or an error row, never a failed job."""
    files = [media.write_tiff([np.arange(640, dtype=np.uint8).reshape(10, 64)], c, t, p) for c in (1, 5, 8, 32773) for t in (False, True) for p in (1, 2)]
    rng, made = np.random.default_rng(8), []
    for f in files:
        start = int.from_bytes(f[4:8], "little")
        for value in (0, 255):
            for at in rng.integers(start, len(f), 30).tolist() + list(range(8)):
                made.append(bytes(f[:at]) + bytes([value]) + bytes(f[at + 1 :]))
    rows = media.tiff_pages(spark.createDataFrame([(i, m) for i, m in enumerate(made)], "id int, media binary").repartition(4), keep=("id",)).select("id", "error").collect()
    assert {r.id for r in rows} == set(range(len(made))) and any(r.error is None for r in rows)
    lying = []
    for tag in (256, 257, 277, 322, 323):
        f = bytearray(files[2])
        at = int.from_bytes(f[4:8], "little") + 2
        while int.from_bytes(f[at : at + 2], "little") != tag:
            at += 12
        for value in (bytes(4), b"\xff" * 4):
            lying.append(bytes(f[: at + 8]) + value + bytes(f[at + 12 :]))
    rows = media.tiff_pages(spark.createDataFrame([(m,) for m in lying], "media binary")).collect()
    assert len(rows) == 10 and all(r.error for r in rows)


def test_no_part_is_decoded_beyond_its_page():
    bomb = __import__("zlib").compress(bytes(10**7))
    assert len(media.inflate(bomb, 100)) == 100 and len(media.lzw_decode(media.lzw_encode(bytes(10**5)), 100)) < 5000 and len(media.packbits_decode(b"\x81\0" * 1000, 100)) == 100


def test_bad_files(spark):
    good = media.write_tiff([np.zeros((5, 64), np.uint8)] * 2)
    loop = bytearray(media.write_tiff([np.zeros((5, 64), np.uint8)]))
    loop[-4:] = loop[4:8]
    files = spark.createDataFrame([(1, None), (2, b""), (3, b"junk junk"), (4, bytes(good)), (5, bytes(loop)), (6, good[:60])], "id int, media binary")
    rows = media.tiff_pages(files, keep=("id",)).collect()
    count = lambda i: (sum(r.id == i and r.error is None for r in rows), sum(r.id == i and r.error is not None for r in rows))
    assert [count(i) for i in range(1, 7)] == [(0, 1), (0, 1), (0, 1), (2, 0), (1, 1), (0, 1)]
    assert media.tiff_pages(files.limit(0), keep=("id",)).count() == 0


def test_pages_leave_by_bytes(spark):
    """Many small files of large pages: no more than a page over PAGES_BYTES waits in a task."""
    import pyarrow as pa

    page = np.zeros((512, 4096), np.uint8)
    file = media.write_tiff([page, page + 1])
    df = spark.createDataFrame([(i, bytearray(file)) for i in range(12)], "k long, media binary")
    assert media.tiff_pages(df, keep=("k",)).where("error IS NULL").groupBy("k").count().where("count = 2").count() == 12
    taken = {}

    def catch(run, schema):
        taken["run"] = run
        raise StopIteration

    class Files:
        schema = df.select("k", "media").schema

        def select(self, *_):
            return self

    Files.mapInArrow = lambda self, run, schema: catch(run, schema)
    try:
        media.tiff_pages(Files(), keep=("k",))
    except StopIteration:
        pass
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([file] * 12, pa.binary())], names=["k", "__media"])
    sizes = [sum(len(x) for x in out.column(6).to_pylist()) for out in taken["run"](iter([batch]))]
    assert sum(sizes) == 24 * page.size and max(sizes) <= media.PAGES_BYTES + page.size
