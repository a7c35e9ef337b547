"""The registered queries on the smallest tables, against brute force or SQL."""

import hashlib
import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lineagrid.llm import pii, queries
from tests.llm.test_operators import brute_components, brute_line_drops, brute_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY 1").fetchall())


@pytest.fixture
def rows(spark, request):
    return {r[0]: r for r in queries.queries()[request.param](spark, SF).collect()}


def encoded(texts, file, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return {d: tokenizer.encode(t, add_special_tokens=False).ids + end for d, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    found = queries.queries()["op1_packing"](spark, SF).collect()
    ids = encoded(texts, "word_bpe_49k.json", [2])
    assert all(r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in found)
    for doc_id, own in itertools.groupby(sorted(found, key=lambda r: (r["doc_id"], r["start"])), key=lambda r: r["doc_id"]):
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[doc_id]))
            at += r["length"]
        assert at == len(ids[doc_id])
    sums = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sums.get(r["sequence_id"], 0)
        sums[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sums.values()) <= 4096 and sum(4096 - n for n in sums.values()) < 0.03 * sum(sums.values()) + 4096


@pytest.mark.parametrize("rows", ["op2_fingerprints"], indirect=True)
def test_op2(rows, texts):
    order = sorted(texts, reverse=True)
    prints = {d: int(rows[d]["fingerprint"], 16) for d in order}
    like = lambda a, b: 1 - bin(a ^ b).count("1") / 128
    for d, after in zip(order, order[1:] + order[:1]):
        t, half = texts[d], len(texts[d]) // 2
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + texts[after][:half]))
        assert r["near_next"] == like(prints[d], prints[after])
        assert r["near_edited"] == like(prints[d], int(r["edited_fingerprint"], 16))
        near = sum(bin(prints[d] ^ p).count("1") <= 3 for p in prints.values())
        assert r["n_near"] == (near if d % 50 == 0 else None)
    assert len({(texts[d], prints[d]) for d in order}) == len(set(texts.values()))


@pytest.mark.parametrize("rows", ["op3_toxicity"], indirect=True)
def test_op3(rows, texts):
    assert set(rows) == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for d, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


@pytest.mark.parametrize("rows", ["op4_pii"], indirect=True)
def test_op4(rows, texts):
    for d, t in texts.items():
        base, r = brute_spans(t), rows[d]
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(shown))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        every = [x for x in r["spans"].split(",") if x]
        assert set(shown) <= set(every) and len(every) == len(shown) + r["n_added"]


def test_op5(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.queries()["op5_exact_dedup"](spark, SF)
    own = sorted(map(tuple, found.select(sorted(found.columns)).collect()))
    other = con.sql(queries.oracle_sql()["op5_exact_dedup"])
    assert own == sorted(other.select(*[duckdb.ColumnExpression(c) for c in sorted(other.columns)]).fetchall())


@pytest.mark.parametrize("rows", ["op6_chat_format"], indirect=True)
def test_op6(rows):
    said = "</s>[INST] ok [/INST]"
    turns = duckdb.sql(f"SELECT conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall()
    turns = [(-7, 0, "user", said), (-7, 1, "assistant", said), *turns]
    for conv, own in itertools.groupby(turns, key=lambda r: r[0]):
        own = list(own)
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        expected = (conv, len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)), len(loss), sha(loss))
        assert tuple(rows[conv])[:5] == expected


@pytest.mark.parametrize("rows", ["op7_near_dedup"], indirect=True)
def test_op7(rows, texts):
    for d, (component, n) in brute_components(list(texts.items())).items():
        assert tuple(rows[d]) == (d, n, component, component == d)


@pytest.mark.parametrize("rows", ["op8_line_dedup"], indirect=True)
def test_op8(rows, texts):
    for (d, t), gone in zip(texts.items(), brute_line_drops(list(texts.values()))):
        lines, r = t.split("\n"), rows[d]
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert (r["n_lines"], r["n_dropped"], r["kept_chars"], r["kept_sha256"]) == (len(lines), len(gone), len(kept), sha(kept))


@pytest.mark.parametrize("rows", ["op9_token_output"], indirect=True)
def test_op9(rows, texts):
    at = 0
    for d, ids in encoded(texts, "byte_bpe_50k.json", [0]).items():
        assert tuple(rows[d]) == (d, at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("rows", ["op10_bpe"], indirect=True)
def test_op10(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, ids in encoded(texts, "word_bpe_49k.json", []).items():
        assert tuple(rows[d]) == (d, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, kept = docs, [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.materialise(stage(spark, held, SF), name)
        assert held.columns == docs.columns and dict(held.dtypes) == dict(docs.dtypes)
        kept.append({r["doc_id"] for r in held.select("doc_id").collect()})
    toxic, exact, near, private = kept[1:]
    scores = {r["doc_id"]: r["predicted"] for r in queries.queries()["op3_toxicity"](spark, SF).collect()}
    assert toxic == {d for d, p in scores.items() if not p}
    firsts = {}
    for d in sorted(toxic):
        firsts.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[d]), d)
    assert exact == set(firsts.values())
    groups = brute_components([(d, texts[d]) for d in sorted(exact)])
    assert near == {d for d, (c, _) in groups.items() if c == d} == private
    final = {r["doc_id"]: r["text"] for r in held.collect()}
    assert all(not brute_spans(t) for t in final.values()) and any("[EMAIL]" in t or "[PHONE]" in t for t in final.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, own in itertools.groupby(sorted(pieces, key=lambda r: (r["doc_id"], r["start"])), key=lambda r: r["doc_id"]):
        ids = list(itertools.chain(*(np.frombuffer(r["ids"], "<u4").tolist() for r in own)))
        assert ids == tokenizer.encode(final[d], add_special_tokens=False).ids + [2]
    assert {r["doc_id"] for r in pieces} == set(final)
