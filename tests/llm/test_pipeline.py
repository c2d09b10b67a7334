"""The pipeline against brute-force versions of its stages, each on what its predecessor kept."""

import hashlib
import re

import pytest

import corpus_pipeline
from tests.llm import test_near_dup, test_packing, test_quality, test_substring_dup
from tracewell.llm import mixing, quality

DATA = "/root/testdata/sf0.001"


def plain_quality(rows):
    norm = lambda x: re.sub(r"[\x20\x09-\x0d]+", " ", x.lower()).strip(" ")
    texts, holders = {}, {}
    for r in rows:
        texts.setdefault(r["source"], set()).add(r["text"])
        for x in (r["text"] or "").split("\n"):
            if x.encode().split():
                holders.setdefault((r["source"], norm(x)), set()).add(r["text"])
    often = {k for k, v in holders.items() if len(v) > quality.LEAST_DOCS and len(v) ** 2 > quality.SPREAD * len(texts[k[0]] - {None})}
    out = []
    for r in rows:
        n, _, _, _, repeated = test_quality.brute(r["text"])
        lines = (r["text"] or "").split("\n")
        left = [x for x in lines if (r["source"], norm(x)) not in often]
        kept = sum(len(x.encode().split()) for x in left)
        if n >= 50 and 100 * repeated <= 50 * n and 100 * kept >= quality.KEPT_PERCENT * n:
            text = "\n".join(left)
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_near_duplicates(rows):
    keep = {d for d, _, _, kept in test_near_dup.brute([(r["doc_id"], r["text"]) for r in rows]) if kept}
    return [r for r in rows if r["doc_id"] in keep]


def plain_substring_dedup(rows):
    found = {d: (n, lost, text) for d, n, lost, text in test_substring_dup.brute([(r["doc_id"], r["text"]) for r in rows])}
    out = []
    for r in rows:
        n, lost, text = found[r["doc_id"]]
        if not lost or lost < n:
            out.append(r | ({"text": text, "n_chars": len(text)} if lost else {}))
    return out


def plain_mixture(rows):
    def topic(t):
        return "contact" if "@" in t else "legal" if re.search("(?i)licen[sc]e|rights reserved", t) else "long" if len(t) >= 4000 else "medium" if len(t) >= 800 else "short"

    cell_of = lambda r: {"source": r["source"], "lang": r["lang"], "topic": topic(r["text"])}
    tokens, cells = {}, {}
    for r in rows:
        c = cell_of(r)
        cells[tuple(c.values())] = c
        tokens[tuple(c.values())] = tokens.get(tuple(c.values()), 0) + len(r["text"].encode().split())
    weight, goals = dict.fromkeys(cells, 1.0), {}
    for d, power in mixing.TEMPER.items():
        sums = {}
        for k, c in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + tokens[k]
        left, goal, free = mixing.KEEP * sum(sums.values()), {}, sum(n**power for n in sums.values())
        for v, n in sorted(sums.items(), key=lambda x: x[1]):  # the smallest first, since their share of themselves is largest
            goal[v] = min(n, left * n**power / free)
            left, free = left - goal[v], free - n**power
        goals[d] = goal
    for _ in range(400):
        for d in mixing.TEMPER:
            held = {}
            for k, c in cells.items():
                held[c[d]] = held.get(c[d], 0) + tokens[k] * weight[k]
            weight = {k: min(1.0, w * goals[d][cells[k][d]] / held[cells[k][d]]) if held[cells[k][d]] else w for k, w in weight.items()}
    u = lambda r: int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
    return [r for r in rows if u(r) < weight[tuple(cell_of(r).values())]]


def test_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    columns = docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (plain_quality, plain_near_duplicates, plain_substring_dedup, plain_mixture), strict=False):
        path = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs, rows = spark.read.parquet(path), plain(rows)
        assert docs.columns == columns
        assert sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"]) == sorted(rows, key=lambda r: r["doc_id"]), name
    enc = test_packing.encoder()
    ids = {r["doc_id"]: [*enc.encode(r["text"], add_special_tokens=False).ids, 2] for r in rows}
    test_packing.check(corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect(), ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == ids.keys()


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "substring dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, " ".join(f"w{i}" for i in range(80)), None, None, 3), (2, "w " * 5000, "en", "s", 1)]])
def test_edge_cases(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert "sequence_id" in docs.columns and docs.count() <= len(rows)
