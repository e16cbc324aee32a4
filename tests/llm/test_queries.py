"""Queries against their SQL, and against brute force where SQL cannot say it."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from docloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = Q.queries()[name](spark, SF)
    cursor = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr) == expected


def test_op1_is_right_on_documents_it_never_learned_from(spark):
    got = Q.queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = labels.merge(got[got.held_out], on="doc_id")
    assert (both.quality == both.predicted).mean() > 0.97


def test_op2_finds_nine_of_ten_neighbours(spark):
    got = Q.queries()["op2_nearest_neighbours"](spark, SF).toPandas()
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, hits, total = e.vec_id.to_numpy(), 0, 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        best = got[got.query_id == q].sort_values("rank")
        assert list(best["rank"]) == [1, 2, 3, 4, 5] and q not in set(best.vec_id)
        assert np.allclose(best.score, s[np.searchsorted(ids, best.vec_id)], atol=1e-12)
        hits += len(set(best.vec_id) & set(ids[np.lexsort((ids, -s))[:5]]))
        total += 5
    assert hits >= 0.9 * total


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op4_equals_all_pairs(spark):
    got = Q.queries()["op4_simhash_near_dedup"](spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    prints = {i: fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    least = dict.fromkeys(prints)
    for i in sorted(prints):
        if least[i] is None:
            todo, least[i] = [i], i
            while todo:
                a = todo.pop()
                for b in prints:
                    if least[b] is None and (prints[a] ^ prints[b]).bit_count() <= 3:
                        least[b] = i
                        todo.append(b)
    for i, p in prints.items():
        assert got.fingerprint[i] == f"{p:016x}" and got.component_id[i] == least[i]


def test_op5_equals_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = Q.queries()["op5_sentencepiece"](spark, SF).toPandas().set_index("doc_id")
    assert got.exact.all()
    for i, t in zip(docs.doc_id, docs.text):
        assert got.n_tokens[i] == len(lib.encode(t)) and got.decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest()


def test_op7_finds_the_articles(spark):
    import html
    import re

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    got = Q.queries()["op7_html_extraction"](spark, SF).toPandas()
    for r in got.itertuples():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages.html[r.page_id], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_op10_stores_every_byte(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = Q.queries()["op10_media_columns"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        raw = t.encode()
        padded = raw + bytes(-len(raw) % 64)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_op8_sources_come_near_their_targets(spark):
    got = Q.queries()["op8_source_mixing"](spark, "/root/testdata/sf0.1").toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken / by.target - 1) < 0.2).all() and abs(by.target.sum() / got["size"].sum() - 1) < 1e-9
