import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries, token_store

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [*"aab ce'stvl  \n\t1²½é漢\U0001f600́\xa0　\x1c\x85_.<|endoftext|>İΣς", "<|endoftext|>", "'ll", " the", " " * 9, "<|startoftext|>"]


def odd_texts(n=200):
    r = random.Random(5)
    made = ["".join(r.choice(ODD) for _ in range(r.randint(0, 200))) for _ in range(n)]
    return [*made, "", " ", "a" * 9000, " " * 70001 + "x", "\n" * 66000, "ab" * 40000 + "!" * 70000 + " z", "é漢" * 30000 + "1" * 70000 + "<|endoftext|>" + "x" * 70000]


def test_encoder_matches_the_library():
    t = Tokenizer.from_file(BYTE)
    for x in odd_texts():
        ids = t.encode(x, add_special_tokens=False).ids
        assert bpe.encode_text(BYTE, x) == ids
        d = bpe.StreamingDecoder(bpe.load_merges(BYTE)[0])
        assert "".join(d.feed(ids[i : i + 2]) for i in range(0, len(ids), 2)) + d.finish() == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("size", [1, 7])
def test_small_feeds_and_windows(size):
    merges = bpe.load_merges(BYTE)[0]
    t = Tokenizer.from_file(BYTE)
    for x in [y[:3000] for y in odd_texts(60)]:
        e, out = bpe.StreamingEncoder(merges), []
        e.long = 5
        for i in range(0, len(x), size):
            out += e.feed(x[i : i + size])
        assert out + e.finish() == t.encode(x, add_special_tokens=False).ids


def test_lookahead_is_sufficient():
    """Tokens that end a lookahead before a prefix's end are those of the whole."""
    merges = bpe.load_merges(BYTE)[0]
    r = random.Random(2)
    words = [bytes(r.choice(b"aeionrst") for _ in range(600)) for _ in range(20)] + [b"a" * 600, b"the" * 200, b"ing" * 200]
    for w in words:
        whole = merges.encode_bytes(w)
        for cut in (350, 400, 500):
            done, stable = 0, []
            for tok in merges.encode_bytes(w[:cut]):
                done += len(merges.token_bytes[tok])
                if done > cut - merges.lookahead:
                    break
                stable.append(tok)
            assert whole[: len(stable)] == stable


@pytest.mark.parametrize("kind", ["words", "no spaces", "one pre-token", "blanks"])
def test_tokens_come_out_when_they_are_certain(kind):
    """Of a text of 50,000 characters, fed a thousand at a time, all but a window has come out after each feed."""
    r = random.Random(3)
    merges, t = bpe.load_merges(BYTE)[0], Tokenizer.from_file(BYTE)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9)))
    text = {"words": " ".join(word() for _ in range(12_000)), "no spaces": "".join(word() + r.choice(",.1漢") for _ in range(12_000)), "one pre-token": "".join(word() for _ in range(12_000)), "blanks": " " * 50_000}[kind][:50_000]
    e, out, done = bpe.StreamingEncoder(merges), [], 0
    for i in range(0, len(text), 1000):
        new = e.feed(text[i : i + 1000])
        out += new
        done += sum(len(merges.token_bytes[k]) for k in new)
        assert e.held <= 4 * merges.lookahead + 1000 and done >= len(text[: i + 1000].encode()) - 3 * (4 * merges.lookahead + 1000)
    assert out + e.finish() == t.encode(text, add_special_tokens=False).ids


def test_bytes_transducer_holds_a_window():
    merges = bpe.load_merges(BYTE)[0]
    s, most, out = bpe.BytesTransducer(merges), 0, []
    for _ in range(200):
        out += s.feed(b"theningabc" * 100)
        most = max(most, len(s.held))
    assert most <= 2 * s.window
    assert out + s.finish() == merges.encode_bytes(b"theningabc" * 20000)


def test_round_trip_rows(docs_of):
    t = Tokenizer.from_file(BYTE)
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "x"), (2, None), (3, ""), *((10 + i, x) for i, x in enumerate(odd_texts(30)))]
    got = sorted(map(tuple, bpe.bpe_round_trip(docs_of(rows), BYTE).collect()), key=str)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.bpe_decode(bpe.bpe_encode(docs_of(rows), BYTE), BYTE)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, x or "") for i, x in rows)
    assert bpe.bpe_round_trip(docs_of([]), BYTE).count() == 0


def test_word_ids_match_the_library():
    t = Tokenizer.from_file(WORD)
    texts = odd_texts()
    got = token_store.WordIds(WORD)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_store(spark, docs_of, sf):
    t = Tokenizer.from_file(WORD)

    def want(rows):
        start, out = 0, []
        for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
            out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        return out

    rows = [(5, "Some Text"), (5, "Some Text"), (5, "again"), (None, "no id"), (2, None), (-3, ""), *((10 + i, x) for i, x in enumerate(odd_texts(300)))]
    assert sorted(map(tuple, token_store.token_store_report(spark, docs_of(rows), WORD, 1).collect()), key=lambda r: r[1]) == want(rows)
    assert token_store.token_store_report(spark, docs_of([]), WORD, 1).count() == 0
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op6_token_store(spark, sf).collect()), key=lambda r: r[1]) == want(whole)


def test_one_document_by_the_index(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/store"
    shards = token_store.write_store(docs_of([(i, "word " * i) for i in range(50)]), WORD, 1, path).collect()
    s = token_store.Shard(path, next(x.shard for x in shards if x.first == 0))
    assert len(s.ids(7)) == 4 * 8
    (tmp_path / "store/dictionary").write_bytes(b"other")
    with pytest.raises(ValueError):
        token_store.Shard(path, s and shards[0].shard)


def test_a_word_looks_up_its_pairs_once():
    """Each merge looks at the pairs beside it only; every round over the whole word took some n * n / 2 looks."""
    merges = bpe.MergeList(queries.tokenizer_path("byte_bpe_50k.json"))

    class Counted(dict):
        looks = 0

        def get(self, *a):
            Counted.looks += 1
            return super().get(*a)

    merges.rank = Counted(merges.rank)
    merges.joined = Counted(getattr(merges, "joined", {}))
    for word in (b" internationalizations", b"characteristically-understood", b"aaaaaaaaaaaaaaaaaaaaaaaa"):
        Counted.looks = 0
        assert merges.encode_bytes(word) == merges._encode_long([merges.byte_ids[x] for x in word])
        assert Counted.looks - 3 * len(word) <= 3 * len(word)
