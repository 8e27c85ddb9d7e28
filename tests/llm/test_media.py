import hashlib
import tarfile
import zlib

from tidemark.llm import media, queries


def check(rows, got):
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(x or "")
    assert len(got) == len(rows)
    for r in got:
        payload = next(p for p in (media.payload_of(x.encode()) for x in texts[r.doc_id]) if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert r.payload_bytes == len(payload) and len(payload) % 576 == 0 and len(payload) > 0
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.width, r.width * r.height) == (576, len(payload))
        assert r.feature == media.feature_of(payload)
        assert r.n_bytes in {len(x.encode()) for x in texts[r.doc_id]}


def test_media(spark, docs_of, sf):
    rows = [(1, "é" * 288), (2, "x" * 575), (3, "x" * 577), (4, None), (5, ""), (None, "n"), (6, "same"), (6, "same"), (7, "same"), (8, "long " * 400_000)]
    got = media.media_report(spark, docs_of(rows)).collect()
    check(rows, got)
    assert len({(r.payload_sha256, r.media_sha256, r.media_bytes) for r in got}) == 7
    assert media.media_report(spark, docs_of([])).count() == 0
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(whole, queries.op3_media(spark, sf).collect())


def test_shards_are_tar_files_and_headers_are_range_reads(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/media"
    rows = media.store_media(docs_of([(i, f"text {i % 7}" * 300) for i in range(40)]), path)
    found = rows.collect()
    for name in {r.shard for r in found}:
        with tarfile.open(tmp_path / "media" / name) as tar:
            for m in tar.getmembers():
                png = tar.extractfile(m).read()
                assert m.name == hashlib.sha256(media.samples_of(png)).hexdigest() + ".png"
                assert any((r.shard, r.offset, r.length) == (name, m.offset_data, m.size) for r in found)
    at = media.places(rows)
    assert at.count() == 7
    heads = {bytes(r.digest): (r.width, r.height, r.bits) for r in media.media_headers(at, path).collect()}
    assert heads == {bytes(r.digest): (576, r.payload_bytes // 576, 8) for r in media.media_features(at, path).collect()}


def test_the_stored_form_by_another_reader(spark, docs_of, tmp_path, monkeypatch):
    """Rows lead to the bytes; a second reader of the format, without the module, gets each text back and each column from it."""
    monkeypatch.setattr(media, "fresh_path", lambda *_: f"file://{tmp_path}/m")
    rows = [(1, "one \n two" * 200), (2, None), (3, "é" * 300), (4, "one \n two" * 200)]
    for r in media.media_report(spark, docs_of(rows)).collect():
        data = (tmp_path / "m" / r.shard).read_bytes()[r.offset : r.offset + r.length]
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.media_bytes, r.media_sha256)
        width, height, depth, colour = int.from_bytes(data[16:20]), int.from_bytes(data[20:24]), data[24], data[25]
        assert (width, height, depth, colour, r.width, r.height, r.bits) == (576, height, 8, 0, 576, height, 8)
        n = int.from_bytes(data[33:37])
        raw = zlib.decompress(data[41 : 41 + n])
        lines = [raw[k * 577 : (k + 1) * 577] for k in range(height)]
        assert data[37:41] == b"IDAT" and all(x[0] == 0 for x in lines)
        payload, text = b"".join(x[1:] for x in lines), (dict(rows)[r.doc_id] or "").encode()
        assert payload[: r.n_bytes] == text and r.n_bytes == len(text) and set(payload[r.n_bytes :]) <= {255}
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 == r.digest
        bands = [[v for line in lines for v in line[1 + 24 * k : 25 + 24 * k]] for k in range(24)]
        assert r.feature == bytes(sum(x) // len(x) for x in bands).hex()
