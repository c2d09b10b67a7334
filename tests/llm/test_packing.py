import zlib
from functools import cache

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tracewell.llm import packing, queries


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit(lengths):
    lengths.sort(reverse=True)
    rooms, want = [], []
    for n in lengths:
        k = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if k == len(rooms):
            rooms.append(20)
        want.append((k, 20 - rooms[k]))
        rooms[k] -= n
    assert packing.first_fit(lengths, 20) == want


@example("Erat, sed. İ.\nÉté, ERAT,! a.b. <|ENDOFTEXT|> <|endoftext|>, x., 'S it'S.\tq, Q\u0307. ")
@settings(deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\u00a0\u0301'sSéÉß×÷ŸİΣœ.,!?;:_$<|endoftext|>")), max_size=60))
def test_words_are_encoded_alone(text):
    small = packing.WordEncoder(packing.vocabulary(), 4, 4)
    own = np.frombuffer(b"".join(x for part in (text[:30], text[30:]) for x in small(packing.words_of(part.encode()))), "<u4").tolist()
    text = text[:30] + " " + text[30:]
    assert own == encoder().encode(text, add_special_tokens=False).ids


def ids_by_text(texts, own):
    return [np.frombuffer(x, "<u4").tolist() for x in own([t.encode() for t in texts])]


@cache
def both():
    return packing.TextEncoder(packing.vocabulary()), encoder()


MARKS = " \n\t\u0085\u00a0\x1c'sStTdDmMlLrRvVeE12\u00b2\u00bd.,!_\u00e9\u00c9\u00df\u00d7\u00aa\u00b5\u00ad"


@example(["it's 'S 'll've!'s ''s 5's's' 'res 'lx 'r'", "", " ", "'", "x'", "'v", "'ll"])
@example(["<|endoftext|>a", "\u0130 \u03a3", "a.b", "\u201cit\u2019s\u201d"])
@settings(deadline=None)
@given(st.lists(st.one_of(st.text(MARKS, max_size=30), st.text(st.characters(max_codepoint=255), max_size=30), st.text(max_size=10)), max_size=6))
def test_texts_are_encoded_together(texts):
    own, enc = both()
    assert ids_by_text(texts, own) == [e.ids for e in enc.encode_batch_fast(texts, add_special_tokens=False)]


def test_every_token_and_pair_of_characters():
    """Merges by rank give what the vocabulary's own merges give, whatever the word."""
    own, enc = both()
    rng = np.random.default_rng(0)
    tokens = [t for t in enc.get_vocab() if t.isascii() and "<|" not in t]
    words = [t.removesuffix("</w>") for t in tokens]
    joined = list(map("".join, rng.choice(np.array(words), (20_000, 4)).tolist()))
    repeated = ["".join(rng.choice(list("aeth"), n)) for n in (*range(1, 60), 99, 100, 101, 499, 500, 501, 3000)]
    latin = [chr(x) + chr(y) for x in range(256) for y in range(256)] + [f"a{chr(x)}a {chr(x)}'s" for x in range(256)]
    texts = [*words, *joined, *repeated, *latin]
    assert ids_by_text(texts, own) == [e.ids for e in enc.encode_batch_fast(texts, add_special_tokens=False)]


def test_latin_texts_need_no_cache_of_words():
    """Their new words cost no more than known ones: nothing is looked up or learned by word."""
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(["er", "th", "\u00e9", "an"], 6)) + "." for _ in range(50)) for _ in range(20)]
    own, enc = packing.TextEncoder(packing.vocabulary()), both()[1]
    assert ids_by_text(texts, own) == [e.ids for e in enc.encode_batch_fast(texts, add_special_tokens=False)]
    assert not own.words.words.young and not own.words.parts.young
    assert ids_by_text(["\u03a9mega"], own) == [enc.encode("\u03a9mega", add_special_tokens=False).ids] and own.words.words.young


def check(pieces, ids_of):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids_of.keys()
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            part = np.array(ids_of[d][at : at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids_of[d]), zlib.crc32(part)) and 0 < p.length <= 4096
            at += p.length
        assert at == len(ids_of[d])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    return sum(map(len, ids_of.values())) / (4096 * len(by_sequence))


def test_query(spark):
    enc = encoder()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    ids = {d.doc_id: [*enc.encode(d.text or "", add_special_tokens=False).ids, 2] for d in docs}
    assert check(queries.op10_packing(spark, "/root/testdata/sf0.01").collect(), ids) > 0.98


def test_edge_cases(spark):
    texts = [None, "", " ", "a", "b " * 10_000, "c " * 4095, "c " * 4096]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    enc = encoder()
    ids = {i: [*enc.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    packed = packing.pack(packing.digests(packing.token_pieces(docs)), group_size=3)
    check(packed.collect(), ids)
    assert packing.pack(packing.token_pieces(docs.limit(0))).count() == 0
    twice = packing.pack(packing.token_pieces(docs.union(docs))).collect()
    assert len(twice) == 2 * packed.count() and len({(p.sequence_id, p.offset) for p in twice}) == len(twice)


def test_many_rows_of_one_id(spark):
    """A third of the rows has one id, or none; groups are split and nothing is lost."""
    rows = [(None if i % 3 else 7, f"w{i % 5} " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.digests(packing.token_pieces(docs)).withColumn("offset", packing.F.lit("x"))
    got = packing.pack(pieces, limit=40, group_size=10).collect()
    assert len(got) == 300 and len({p.sequence_id for p in got}) > 10
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 40


def test_bytes_that_are_no_utf8(spark):
    docs = spark.createDataFrame([(1, b"ab\xff cd")], "doc_id long, b binary").selectExpr("doc_id", "CAST(b AS STRING) AS text")
    want = [*encoder().encode("ab\ufffd cd", add_special_tokens=False).ids, 2]
    assert packing.token_pieces(docs).collect()[0].ids == np.array(want, "<u4").tobytes()
