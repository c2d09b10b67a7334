import functools
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tests.helpers import DATA
from tracewell.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@functools.cache
def of_a():
    """Tokenizer A by its own library and file; the operator reads the same vocabulary as ranks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def whole(text):
    """(groups as pairs of id lists) of a whole text by both tokenizers and a walk over its bytes; None where it has no tokens."""
    al = alignment._aligner(alignment.vocabularies())
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = of_a().encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    x, y = [al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]
    if b"".join(x) != raw or b"".join(y) != raw:
        return None
    ends_a, ends_b, groups = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist(), []
    start = 0
    for end in sorted({*ends_a} & {*ends_b}):
        groups.append(([i for i, e in zip(a, ends_a) if start < e <= end], [i for i, e in zip(b, ends_b) if start < e <= end]))
        start = end
    return groups


def brute(docs):
    of = [(i, whole(t)) for i, t in docs]
    count = Counter(p for _, g in of for p in {(a, b) for x, y in g or [] for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, g in of:
        links = [(a, b) for x, y in g or [] for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


TEXTS = [
    None, "", " ", "  ", "hello world", "hello  world ", " a", "a\nb c\td\r\n\r\ne", "naïve façade — œuvre ½ ﬁn", "日本語 テキスト 😀👍🏽 x", "<s>x</s><unk> <|endoftext|> hi", "a▁b c", "x   y 　 z", "don't can't I'm 'll we've",
    "a\0b", "1234567890 12 3 x=1;y=2", "é é ́", "word " * 3000, "x" * 20_000, "hello world",
]


@pytest.mark.parametrize("held", [1 << 20, 400, 0])
def test_against_brute_force(spark, held):
    docs = [(i % 18, t) for i, t in enumerate(TEXTS)] + [(None, "hello world"), (5, f"number {7} of many")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_best int").repartition(3)
    got = alignment.cross_aligned(df, held_bytes=held, segment_keys=50, chunk_rows=20)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, DATA).collect()), key=repr) == brute(docs)


def test_empty(spark):
    assert alignment.cross_aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@example("a   y   z\x1c \x85 q")
@example("x ▁y▁ z  <0x41> ﬃ​ ​é")
@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t ́'stdSéÉß.,!?;<|endoftext|>▁0x")), max_size=80))
def test_chunks_are_aligned_alone(text):
    al = alignment._aligner(alignment.vocabularies())
    chunks = alignment.chunks_of(text) if text else []
    assert chunks == (alignment._CUT.split(text) if text else [])
    good, sizes, links, words = al.aligned(chunks, True) if chunks else (np.ones(0, bool), np.empty((0, 4), int), np.empty(0, int), [])
    groups = whole(text)
    if groups is None:
        assert not chunks or not good.all()
    else:
        assert good.all()
        assert "".join(words)[:-1] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert links.tolist() == [a * al.b_size + b for x, y in groups for a in x for b in y]
        assert sizes.sum(0).tolist() == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links)]


def test_chunks_when_full(monkeypatch):
    """A cache of a few chunks gives what a large one does."""
    monkeypatch.setattr(alignment, "CACHED", 3)
    known, large = (alignment.Chunks(alignment._aligner(alignment.vocabularies()), True) for _ in range(2))
    for k in range(6):
        docs = [["a", f"b{k}", "a▁", "c"], ["a", "c", f"b{k // 2}"], []]
        monkeypatch.setattr(alignment, "CACHED", 3)
        at, cut = known(docs)
        monkeypatch.setattr(alignment, "CACHED", 1000)
        more, same = large(docs)
        assert cut.tolist() == same.tolist() == [0, 0, 3, 3]
        assert [known.words[i] for i in at] == [large.words[i] for i in more] and known.links_of(at)[0].tolist() == large.links_of(more)[0].tolist()


@settings(deadline=None, max_examples=50)
@given(st.sets(st.integers(0, 1 << 31), min_size=1, max_size=300))
def test_hash_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys))
    found, held = alignment.pilots(keys)
    at = alignment.slots(keys, found, len(keys))
    assert sorted(at.tolist()) == list(range(len(keys))) and (held[at] == keys).all()
    assert len(found) <= max(1, len(keys) // alignment.GROUP_KEYS)


def test_segments_agree(spark):
    pairs = [0, 1, 31_999, 1_600_000_000, (1 << 40) - 1]
    df = spark.createDataFrame([(p,) for p in pairs], "pair long")
    for n in (1, 7, 1000):
        assert [r[0] for r in df.select(alignment._segment_of(df.pair, n)).collect()] == alignment.segments_of(np.array(pairs), n).tolist()
