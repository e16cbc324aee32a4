"""Small documents with known results: nulls, empty and long texts, ties, repeats, empty tables,
columns with clashing names."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, chat, html_text, line_dedup, media, mixing, quality, simhash, urls
from docloom.llm.components import connected_components
from docloom.llm.pieces import Pieces, decode_ids, encode_texts
from docloom.llm.queries import piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def word_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (None, "x y", "a"), (2, "", None), (3, "long word " * 30_000, "b"), (4, " \n\t\n ", "b")]


# -- line dedup


def gone(spark, texts):
    out = line_dedup.drop_repeated_lines(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    return [r.text for r in out.orderBy("doc_id").collect()]


def test_long_repeated_lines_go_and_the_first_stays(spark):
    p, q = words(60, 1), words(60, 2)
    assert gone(spark, [f"a\n{p}\nb", f"c\n{p}", p, q]) == [f"a\n{p}\nb", "c", "", q]


def test_runs_of_short_lines_count_together(spark):
    run = "\n".join(words(12, k) for k in range(5))
    part = "\n".join(run.split("\n")[:3])
    assert gone(spark, [f"x\n{run}\ny", f"z\n{run}", f"w\n{part}\nv"]) == [f"x\n{run}\ny", "z", f"w\n{part}\nv"]


def test_repeats_within_a_document(spark):
    p = words(55, 3)
    assert gone(spark, [f"{p}\nmid\n\n{p}"]) == [f"{p}\nmid\n"]


def brute(texts, least=50):
    lines = [t.split("\n") for t in texts]
    word_lines = [[(k, x) for k, x in enumerate(ls) if x.split()] for ls in lines]
    seen, out = {}, [set() for _ in texts]
    for d, ls in enumerate(word_lines):
        for i in range(len(ls)):
            for j in range(i, len(ls)):
                key = tuple(x for _, x in ls[i : j + 1])
                if sum(len(x.split()) for x in key) >= least and seen.setdefault(key, (d, i)) != (d, i):
                    out[d].update(k for k, _ in ls[i : j + 1])
    return ["\n".join(x for k, x in enumerate(ls) if k not in out[d]) for d, ls in enumerate(lines)]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [words(rng.choice([3, 10, 25, 60]), k) for k in range(12)] + [""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    full = lambda out: [[x for x in t.split('\n') if x] for t in out]
    assert full(gone(spark, texts)) == full(brute(texts))


def test_line_dedup_of_odd_rows(spark):
    rows = docs(spark, ODD).withColumn("gone", F.lit(7)).withColumns({"line": F.lit("l"), "_id": F.lit(1), "_hash": F.lit(2), "_gone": F.lit(3), "d": F.struct(F.lit(4).alias("text"))})
    out = line_dedup.drop_repeated_lines(rows)
    assert out.columns == rows.columns and out.count() == len(ODD)
    assert {r.doc_id: r.text for r in out.collect()}[1] is None
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


# -- near copies


def test_links_equal_all_pairs_for_any_limit(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 40)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False))) for b in rng.choice(base, 200)]
    prints = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    for limit in (1, 3, 4):
        want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= limit}
        assert {(r.a, r.b) for r in simhash.near_links(df, limit).collect()} == want


@pytest.mark.parametrize("n", [10, 10**5, 10**9])
def test_part_limits_are_complete(n):
    rng = np.random.default_rng(2)
    p = rng.uniform(0.2, 0.8, 64)
    both = n * (np.outer(p, p) + np.diag(p - p * p))
    parts = simhash.allocate(n, both, 3)
    assert sum(t + 1 for _, t in parts) == 4 and len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(101)} | {k: 1000 for k in range(1000, 1100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_of_odd_rows(spark):
    t = words(80, 1)
    rows = docs(spark, [*ODD, (9, t, "s"), (8, t.upper(), "s"), (10, t + " more", "s")]).withColumn("component_id", F.lit("c")).withColumn("a", F.lit(1))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert found[9] == 8 and found[1] == found[2] == found[4] == 1
    rows = rows.withColumns({"_kept": F.lit(5), "_sequence": F.lit(6), "_of": F.lit("u")})
    kept = simhash.keep_one(rows, simhash.similar_documents(rows))
    assert kept.columns == rows.columns and {(r._kept, r._sequence, r._of) for r in kept.collect()} == {(5, 6, "u")}
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 8]
    none = docs(spark, [])
    assert simhash.keep_one(none, simhash.similar_documents(none)).count() == 0


def test_similar_texts_against_all_pairs(spark):
    rng, texts = random.Random(9), []
    for k in range(12):
        base = words(rng.randint(60, 150), k).split()
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = words(1, rng.random())
            texts.append(" ".join(copy) + " " * rng.randint(0, 2))
    sets = [word_shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}
    assert [got[i] for i in range(len(texts))] == group and len(set(group)) < len(texts)


def test_replaced_and_appended_passages_are_all_found(spark):
    rng, texts = random.Random(4), []
    vocabulary = words(400, "v").split()
    for _ in range(60):  # texts of a small vocabulary with a common line in each; a copy of each has one passage replaced or appended
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 250))]
        at, n = rng.randrange(60), len(base) * rng.randint(4, 9) // 100
        changed = [*base[:at], *(rng.choice(vocabulary) for _ in range(n)), *base[at + n :]]
        longer = [*base, *(rng.choice(vocabulary) for _ in range(len(base) * rng.randint(10, 24) // 100))]
        texts += [" ".join([*x, *vocabulary[:12]]) for x in (base, changed, longer)]
    sets = [word_shingles(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 60
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert all(any(i in p for p in pairs) for i, c in got.items() if c != i)


def test_a_shared_passage_does_not_join_texts_nor_lose_pairs(spark):
    """Texts that are mostly one passage, some of them similar, and a group whose members are near each other in a chain."""
    passage, texts = words(100, "p"), []
    for k in range(30):
        texts += [f"{passage} {words(22, k)}", f"{passage} {words(22, k)} {words(4, k + 99)}"]
    chain = words(120, "c").split()
    for k in range(40):
        chain[3 * k % 120] = words(1, f"c{k}")
        texts.append(" ".join(chain))
    sets = [word_shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == group and len(set(group)) == 31


def test_bitmaps_rule_out_no_similar_pair(spark):
    rng, rows = np.random.default_rng(2), []
    for _ in range(200):
        x = np.unique(rng.integers(-1 << 62, 1 << 62, rng.integers(1, 2200)))
        y = np.unique(np.concatenate((x[rng.integers(0, 3) :], rng.integers(-1 << 62, 1 << 62, rng.integers(0, 300)))))
        differ = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(simhash.bitmap(x).tolist(), simhash.bitmap(y).tolist(), strict=True))
        assert differ <= len(np.setxor1d(x, y))
        wide = simhash.wide_bitmap(x), simhash.wide_bitmap(y)
        assert (wide[0] is None) == (len(x) <= 512)
        if wide[0] is not None and wide[1] is not None:
            rows.append((wide[0].tolist(), wide[1].tolist(), len(np.setxor1d(x, y))))
    found = spark.createDataFrame(rows, "x array<long>, y array<long>, most int").select(simhash.bits_apart(F.col("x"), F.col("y")).alias("bits"), "most", (F.size("x") != F.size("y")).alias("folded")).collect()
    assert all(r.most / 3 < r.bits <= r.most for r in found if r.most > 3) and any(r.folded for r in found)


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c, d = (words(80, f"text {k}") for k in "abcd")
    rows = docs(spark, [(None, a, "s"), (None, b, "s"), (None, b.upper(), "s"), (None, c + " more", "s"), (5, c, "s"), (5, d, "s"), (4, d + " more", "s"), (6, words(80, "e"), "s"), (6, words(80, "f"), "s"), (6, words(80, "f"), "s")])
    kept = simhash.keep_one(rows, simhash.similar_documents(rows)).collect()
    want = [(None, a), (None, b), (5, c), (4, d + " more"), (6, words(80, "e")), (6, words(80, "f"))]
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == sorted((i or 0, t) for i, t in want)


# -- mixing


def test_targets_fill_up_to_three_times(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), (None, 5), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 3.0 and got["c"] == 0.0 and got[None] == 15.0 and got["a"] == pytest.approx(106 - 18)


def test_mix_repeats_rows_and_is_the_same_again(spark):
    rows = docs(spark, [*ODD, *[(100 + i, words(10, i), f"s{i % 3}") for i in range(300)]])
    one, two = (sorted((r.doc_id or 0) for r in mixing.mix_sources(rows).collect()) for _ in range(2))
    assert one == two and max(one.count(i) for i in set(one)) <= 3
    clash = rows.withColumn("size", F.lit("x")).withColumn("_weight", F.lit(1)).withColumn("copies", F.lit(5))
    plan = mixing.plan_mix(clash)
    assert plan.count() == rows.count() and dict(plan.dtypes)["size"] == "bigint" and plan.where("doc_id = 1").first()["size"] == 0
    assert mixing.plan_mix(docs(spark, [])).count() == 0


# -- urls


def test_mix_keeps_columns_of_any_name(spark):
    rows = docs(spark, [(i, words(10, i), f"s{i % 3}") for i in range(30)]).withColumns({c: F.lit(7) for c in ("_source", "_copy", "_whole", "copies", "target")})
    got = mixing.mix_sources(rows).collect()
    assert got and {(r._source, r._copy, r._whole, r.copies, r.target) for r in got} == {(7, 7, 7, 7, 7)}
    assert {r._source for r in mixing.plan_mix(rows).collect()} == {7}


def test_rules_of_hosts_and_paths(spark):
    cases = {
        "http://a.COM/en/x?y": ("com/en/", "block"), "https://www.example.com/en/77": ("example.com/en/7", "allow"), "https://notexample.com/en/7": ("com/en/", "block"),
        "http://x.net/de/": ("net/de/", "allow"), "http://b.example.net/de/8z#f": ("example.net/de/8", "block"), "http://q.org/es/1": ("org/es/", "block"), "http://q.org/esx": (None, "allow"),
        "x.com/en/": (None, "allow"), "": (None, "allow"), None: (None, "allow"), "http://m.ads-track.example.org/fr/1": (None, "block"), "a://://b.com/en/": (None, "allow"), "http://com/en/\n": ("com/en/", "block"),
        "http://x.com" + "/en/" * 50_000: ("com/en/", "block"),
    }
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.url: r for r in urls.judge_urls(rows).collect()}
    assert {u: (r.rule, r.verdict) for u, r in got.items()} == cases
    assert (got[None].host, got[None].path) == ("", "") and got["http://a.COM/en/x?y"].host == "a.com" and got["http://a.COM/en/x?y"].path == "/en/x"
    assert urls.judge_urls(rows.limit(0)).count() == 0


def test_rules_without_tokens_run_everywhere(spark):
    rows = spark.createDataFrame([("http://a.b/~x",), ("http://a.b/x",)], "url string")
    got = {r.url: r.verdict for r in urls.judge_urls(rows, rules=[urls.Rule(r".*~", "block", ())]).collect()}
    assert got == {"http://a.b/~x": "block", "http://a.b/x": "allow"}


# -- chat


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 0.0), (1, 4, 3, "user", "more", 0.0), (2, 9, 8, "system", None, None), (None, 1, None, None, "x", None), (3, 1, 2, "user", "c", 0.0), (3, 2, 1, "user", "c", 0.0)]
    got = chat.format_reply_trees(tree(spark, rows))
    assert {(r.tree_id, r.branch_rank): r.formatted for r in got.collect()} == {
        (1, 1): "<s><|user|>q</s><|assistant|>good</s><|user|>more</s>",
        (1, 2): "<s><|user|>q</s><|assistant|>bad</s>",
        (2, 1): "<s><|system|></s>",
        (None, 1): "<s><||>x</s>",
    }
    assert chat.format_reply_trees(tree(spark, []), best=1).count() == 0


def test_long_chains_and_control_strings_come_back(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("<>[]|\\/s INST") for _ in range(rng.randint(0, 40))) for _ in range(70)] + ["\\" * 5, "<|user|>", "</s>"]
    rows = spark.createDataFrame([(5, i, "assistant" if i % 2 else "us|er>", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = chat.format_reply_trees(chat.turns_to_chain(rows)).select(chat.parse_formatted(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m"), "formatted").first()
    assert [x.text for x in r.t] == texts and r.t[0].role == "us|er>" and r.m == "".join(texts[1::2])
    assert r.formatted.count("</s>") == len(texts)


# -- pieces


@pytest.fixture(scope="module")
def model():
    return Pieces(piece_model())


def test_stream_equals_whole_search(model):
    rng = random.Random(6)
    for _ in range(40):
        text = "".join(rng.choice("aabcdeéthing字😀") for _ in range(rng.randint(64, 400)))
        want = b"".join(model._packed.get(p) or model._spelled(p) for p in model._merge(text))
        assert model._stream(text) == want


def test_the_window_does_not_grow_with_the_text(model):
    text = "".join(random.Random(8).choices("aabcdeéthing字", k=10_000_000))
    model.searched = model.widest = 0
    ids = model.encode(text)
    assert model.searched == len(text) + 1 and model.widest <= 16 * model.longest
    assert model.decode(memoryview(ids).cast("i").tolist()) == text


def test_every_document_goes_through_the_search(spark, model):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        fresh = Pieces(piece_model())
        fresh.encode(r.text)
        stretches = {w for w in r.text.split(" ") if w}
        assert fresh.searched >= sum(len(w) for w in stretches if "\n" not in w)


def as_unigram(proto):
    """The bytes of a model file with the kind of its training settings set to unigram."""
    at = 0
    while at < len(proto):
        key, at = proto[at], at + 1
        size = shift = 0
        while True:
            byte, at = proto[at], at + 1
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        if key == 0x12:
            spec = proto[at : at + size]
            assert spec.count(b"\x18\x02") == 1
            return proto[:at] + spec.replace(b"\x18\x02", b"\x18\x01") + proto[at + size :]
        at += size
    raise AssertionError("no settings")


def test_unigram_ids_have_the_largest_sum_of_scores(spark, model, tmp_path):
    import sentencepiece

    path = str(tmp_path / "unigram.model")
    with open(piece_model(), "rb") as f, open(path, "wb") as g:
        g.write(as_unigram(f.read()))
    lib, mine, rng = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path), random.Random(5)
    assert not mine.bpe
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += ["".join(rng.choice("aabcdeéthing字😀 \n") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    total = same = 0
    for t in texts:
        assert mine.decode(np.frombuffer(mine.encode(t), "<i4").tolist()) == t
        for word in t.replace("\n", " ").split():
            ids, theirs = np.frombuffer(mine.encode(word), "<i4").tolist(), lib.encode(word)
            total, same = total + 1, same + (ids == theirs)
            assert ids == theirs or sum(map(lib.get_score, ids)) > sum(map(lib.get_score, theirs)), word
    assert total > 10_000 and same >= 0.9 * total
    for _ in range(300):  # all ways to cut a short word
        word = "".join(rng.choice("thinger") for _ in range(rng.randint(1, 9)))
        best = {0: 0.0}
        for end in range(1, len(word) + 2):
            best[end] = max(best[k] + mine.score[("▁" + word)[k:end]] for k in range(end) if ("▁" + word)[k:end] in mine.score)
        assert sum(map(lib.get_score, np.frombuffer(mine.encode(word), "<i4").tolist())) == best[len(word) + 1]


def test_any_text_comes_back(model):
    rng = random.Random(7)
    for t in ["", " ", "▁", " ▁ a▁", "\n\n", "a" * 5000, "\x00", "<s> <0x41>", *("".join(rng.choice("ab ▁\n\té字😀<>") for _ in range(30)) for _ in range(300))]:
        assert model.decode(np.frombuffer(model.encode(t), "<i4").tolist()) == t


def test_pieces_of_odd_rows(spark):
    rows = docs(spark, ODD).withColumn("token_ids", F.lit("old"))
    got = decode_ids(encode_texts(rows, piece_model()), piece_model()).collect()
    assert all(r.decoded == r.text for r in got) and {r.doc_id: r.token_ids for r in got}[2] == []
    assert encode_texts(docs(spark, []), piece_model()).count() == 0


# -- media


def test_media_of_odd_rows(spark):
    rows = docs(spark, ODD).withColumn("media", F.lit("old")).withColumn("width", F.lit("old"))
    got = {r.doc_id: r for r in media.media_features(media.store_text(rows)).collect()}
    assert got[1].samples_sha256 == got[2].samples_sha256 == hashlib.sha256(bytes(64)).hexdigest() and got[3].error is None
    assert media.store_text(docs(spark, [])).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(media.encode_bytes([bytes(64)])[0][:-12])), (4, bytearray(media.encode_bytes([b"x" * 128])[0]))], "id int, media binary")
    errors = {r.id: r.error for r in media.media_features(broken).collect()}
    assert errors[4] is None and all(errors[k] for k in (1, 2, 3))


def test_bytes_of_several_images_come_back():
    rng = random.Random(8)
    for n in (1, 5, 8128, 8129):
        payload = rng.randbytes(64 * n)
        images = media.parse_jpeg(media.encode_bytes([payload])[0])
        assert b"".join(t.tobytes() for t in media.thumbnails(images)) == payload


def test_ac_terms_and_colour_are_skipped():
    """An image of 16x16 with subsampled colour and AC terms, coded here bit by bit."""
    tables = {0x00: (media.DC_COUNTS, media.DC_SYMBOLS), 0x10: ((0, 2, 1, *[0] * 13), (0x00, 0x01, 0x12))}
    dc = {s: (c, n) for s, c, n in media.huffman_codes(*tables[0x00])}
    ac = {s: (c, n) for s, c, n in media.huffman_codes(*tables[0x10])}
    bits = ""

    def put(code, n):
        nonlocal bits
        bits += f"{code:0{n}b}" if n else ""

    def value(x):
        size = abs(x).bit_length()
        return size, (x if x >= 0 else x + (1 << size) - 1)

    last = {"y": 0, "c": 0}
    levels = [10, -20, 30, 5]
    for name, level in [*[("y", x) for x in levels], ("c", 3), ("c", 3)]:
        size, extra = value(level - last[name])
        last[name] = level
        put(*dc[size])
        put(extra, size)
        put(*ac[0x01])  # one term of one bit, then one after a zero, then the end
        put(1, 1)
        put(*ac[0x12])
        put(2, 2)
        put(*ac[0x00])
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, bytes([0, 8, *[1] * 63])) + seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += b"".join(seg(0xC4, bytes([k, *c, *s])) for k, (c, s) in tables.items())
    image = head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    assert media.thumbnails(media.parse_jpeg(image))[0].tolist() == [[138, 108], [158, 133]]


# -- neighbours


def test_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, float(i % 3)]) for i in range(1, 40)] + [(0, [1.0, 2.0, 0.0]), (90, None), (91, [0.0, 0.0, 0.0]), (92, [nan, 1.0, 1.0]), (93, [inf, 1.0, 1.0]), (94, [None, 1.0, 1.0]), (95, [1.0]), (0, [1.0, 2.0, 0.0]), (None, [1.0, 2.0, 3.0]), (96, [])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = ann.search(vectors, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 3), (2, 6), (3, 9), (4, 12), (5, 15)]
    assert ann.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    few = vectors.where("vec_id in (0, 1, 2)")
    assert ann.search(few, F.col("vec_id") == 0).count() == 2


def test_recall_among_many_vectors(spark, tmp_path):
    """100,000 vectors, half of them in planted clusters; a tenth of a per cent is scored exactly."""
    import pandas as pd

    rng = np.random.default_rng(12)
    centres = rng.standard_normal((2500, 32))
    x = np.concatenate((np.repeat(centres, 20, 0) + 0.35 * rng.standard_normal((50_000, 32)), rng.standard_normal((50_000, 32))))
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "vec": 1, "group": "g"}).to_parquet(tmp_path / "v.parquet")
    got = ann.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 500 == 0).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.arange(0, len(x), 500)
    near = unit[queries] @ unit.T
    near[np.arange(len(queries)), queries] = -9
    want = {q: set(np.argsort(-near[i])[:5]) for i, q in enumerate(queries)}
    found = got.groupby("query_id").vec_id.agg(set)
    assert len(got) == 5 * len(queries) and np.mean([len(found[q] & want[q]) / 5 for q in queries]) >= 0.9


def test_parallel_error_is_what_the_loss_reduces():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 16))

    def parallel(eta):
        book = ann.Codebook.fit(x, eta=eta)
        parts = book._parts(ann.unit(x))
        codes = book._codes(parts)
        r = parts - np.stack([book.centres[p][codes[:, p]] for p in range(codes.shape[1])], 1)
        return ((r * parts).sum((1, 2)) ** 2).mean()

    assert parallel(8.0) < parallel(1.0)


# -- quality


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    model = quality.AttentionModel()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, counts, y = rng.standard_normal((9, quality.FEATURES)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])

    def loss():
        z = model._forward(x, counts)["logit"]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads = model._gradients(x, counts, y)
    for name, g in grads.items():
        at = tuple(0 for _ in g.shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-2, abs=1e-6)


def test_scores_equal_plain_loops(spark):
    """Features, attention and score once more, a passage and a byte at a time."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12).collect()] + ["", "same same word", "é" * 399 + "a b"]
    model = quality.AttentionModel(seed=8)
    model.mean, model.scale = np.full(quality.FEATURES, 0.01, np.float32), np.full(quality.FEATURES, 2.0, np.float32)
    got = model.score(*quality.bag_features([t.encode() for t in texts]))
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    for text, score in zip(texts, got, strict=True):
        raw = text.encode()
        begins = [i for i in range(len(raw)) if raw[i] > 32 and (i == 0 or raw[i - 1] <= 32)]
        words = [bytes(b for b in raw[i : next((j for j in range(i, len(raw)) if raw[j] <= 32), len(raw))]) for i in begins]
        encoded, weights = [], []
        for k in range(max(1, -(-len(raw) // 400))):
            counts, n = np.zeros(100), 0
            for i in range(400 * k, min(400 * k + 400, len(raw))):
                counts[(quality._KIND[raw[i - 1]] if i else 4) * 10 + quality._KIND[raw[i]]] += 1
                n += 1
            of = [w for w, i in enumerate(begins) if i // 400 == k]
            repeats = sum(w > 0 and words[w] == words[w - 1] for w in of) / max(len(of), 1)
            x = np.concatenate((np.sqrt(counts / max(n, 1)), [n / 400, math.log1p(len(raw)) / 10, repeats]))
            h = np.tanh((x - 0.01) * 2 @ p["W"] + p["Wb"])
            gate = np.tanh(h @ p["V"] + p["Vb"]) / (1 + np.exp(-(h @ p["U"] + p["Ub"])))
            encoded.append(h)
            weights.append(math.exp((gate @ p["w"])[0]))
        z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / sum(weights)
        assert 1 / (1 + math.exp(-((z @ p["c"])[0] + p["cb"][0]))) == pytest.approx(score, abs=1e-4)


def test_training_reads_whole_long_documents(spark):
    """What tells the labels apart lies behind the first 30,000 bytes."""
    rows = [(i, "plain words of text. " * 1500 + ("##!!%% " if i % 2 else "more words. ") * 800, "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.train_model(docs(spark, rows), labels)
    got = quality.score_documents(docs(spark, rows), model, score_name="s1", predicted="p1").collect()
    assert all(r.p1 == r.doc_id % 2 for r in got)


def test_quality_of_odd_rows(spark):
    rows = docs(spark, ODD).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train_model(rows, labels)
    got = quality.score_documents(rows, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(docs(spark, []), model).count() == 0


# -- pages

PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div id="cookie-banner">cookies</div>
<article class="post"><h1>T &amp; t</h1><p>one&nbsp;two<p>three <b>bo</b>ld<br>next<div class="ad-box">buy</div><ul><li>x<li>y</ul>
<section class="comments"><p>no</section><form>f</form><!-- c --><script>if (a < b) "</p>"</script><table><tr><td>1<td>2</table></article><aside>s</aside><footer>f</footer>"""


def test_articles(spark):
    assert html_text.Page(PAGE).main_text() == "T & t\none two\nthree bold next\nx\ny\n1\n2"


def test_templates_show_what_all_pages_say(spark):
    page = "<html><body><div>Welcome to the site</div><div class='t'><p>{}</p><p>{}</p></div></body></html>"
    rows = [(i, "http://h.com/1", page.format(words(4, i), words(3, i + 50)), "x") for i in range(5)] + [(9, "http://one.com/", page.format("a", "b"), "x"), (10, None, None, "x"), (11, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[0] == f"{words(4, 0)}\n{words(3, 50)}" and got[9] == "Welcome to the site\na\nb" and got[10] == got[11] == ""
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_templates_count_the_text_of_every_page(spark):
    page = "<html><body><div>Welcome to the site</div>{}</body></html>"
    rows = [(i, "http://h.com/1", page.format(f"<div><p>{words(4, i)}</p></div>")) for i in range(4)] + [(4, "http://h.com/2", page.format(f"<article><p>{words(4, 4)}</p></article>"))]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: words(4, i) for i in range(5)}


def test_templates_hold_within_articles_and_mains(spark):
    rows = [(i, "http://h.com/1", f"<html><body><{tag}><div>Read our terms</div><p>{words(4, i)}</p></{tag}></body></html>") for tag in ("article", "main") for i in range(3)]
    pages = spark.createDataFrame([(k, f"http://{k // 3}.com/", h) for k, (_, _, h) in enumerate(rows)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract_text(pages).collect()} == {k: words(4, k % 3) for k in range(6)}


def test_articles_of_comments_and_teasers_and_notices_within(spark):
    page = """<main><article class="teaser"><p>other story</p></article><article><h1>T</h1><p class="notice">main point</p><div class="notice">we use cookies</div><p class="ad">buy</p>
    <p>end</p></article><article class="comment"><p>reader says</p></article><article id="comment-7"><p>reader too</p></article></main>"""
    assert html_text.Page(page).main_text() == "T\nmain point\nend"
    assert html_text.Page("<article class='card'><p>only</p></article><article class='comment'>no</article>").main_text() == "only"


def test_the_same_text_without_article_elements(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    want = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert {r.page_id: r.text for r in html_text.extract_text(renamed).collect()} == want and all(want.values())


def test_templates_equal_gathered_vectors(spark):
    """Brute force: every token's whole vector of a host, compared with that of the root and of its element."""
    rng, rows = random.Random(3), []
    for host in range(14):
        for k in range(rng.choice([1, 2, 3, 5, 8])):
            items = "".join(f"<li>{words(2, rng.random())}<p>{'Reply' if host % 2 else words(1, rng.random())}</p></li>" for _ in range(rng.randint(0, 4)))
            same = "<p>Part of all</p>" if host != 3 or k else ""
            rows.append((len(rows), f"http://h{host}.org/{k}", f"<body><div>Site {host}</div>{same}<section>{words(5, rng.random())}</section><ul>{items}</ul><i>{rng.choice('ab')}</i></body>"))
    rows += [(len(rows), "http://copy.org/1", "<p>all alike</p>")] * 4
    want = {}
    for host in {r[1].split("/")[2] for r in rows}:
        sources = [r[2] for r in rows if r[1].split("/")[2] == host]
        parsed = [html_text.Page(x) for x in sources]
        tags = [{p: x.tags.count(p) for p in x.tags} for x in parsed]
        texts = [{} for _ in parsed]
        for x, t in zip(parsed, texts, strict=True):
            for path, text, *_ in x.blocks:
                t[path, text] = t.get((path, text), 0) + 1
        template = set()
        for key in {k for t in texts for k in t}:
            vector, parent = [t.get(key, 0) for t in texts], [t.get(key[0], 0) for t in tags]
            if len(sources) >= 3 and len(set(sources)) > 1 and sum(n > 0 for n in vector) >= 3 and (vector == [1] * len(sources) or (vector == parent and sum(vector) > sum(n > 0 for n in vector))):
                template.add(key)
        want[host] = template
    assert sum(len(t) for t in want.values()) > 8 and any(text == "Reply" for t in want.values() for _, text in t)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    vectors = html_text.token_vectors(df.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html"))
    got = {r.host: set(r.template) for r in html_text.templates(vectors).collect()}
    assert got == {h: {html_text.block_token(*k) for k in t} for h, t in want.items() if t}
    for r in html_text.extract_text(df).collect():
        lines, page = (r.text or "").split("\n"), html_text.Page(rows[r.page_id][2])
        assert lines == [t for p, t, *_ in page.blocks if (p, t) not in want[r.url.split("/")[2]]] or r.text == ""


def test_pages_with_any_columns_repeats_and_long_texts(spark):
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "http://a.b/", long, "h", 1, 2, "s")] * 2 + [(2, None, "<p>x", "h", 1, 2, "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _of int, _template int, _source string")
    got = html_text.extract_text(df).collect()
    assert sorted(len(r.text) for r in got) == [1, 999_999, 999_999] and {(r._host, r._of, r._template, r._source) for r in got} == {("h", 1, 2, "s")}


def test_deep_and_broken_pages():
    assert html_text.Page("<div><b>" * 20_000 + "x").main_text() == "x"
    assert html_text.Page("<p>a <b <i>c</p> d &lt; &#x41; &bogus; <!-- open").main_text().startswith("a")
    assert html_text.Page('<a href="x>y <p>z').main_text() == "y\nz"
