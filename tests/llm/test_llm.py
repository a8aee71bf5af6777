"""Operators on training text against the libraries, brute force, or round trips; and their edge cases."""

import collections
import hashlib
import json
import random
import re
import resource
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from caseworks.llm import bpe, chat, components, exact_dedup, langid, lm, memory, mixing, near_dedup, quality, queries, rules, token_counts, workspace

DATA = "/root/testdata/sf0.001"
RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, _norm string, size long, row long"
EDGE = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 0), (4, "one two three four five six", "en", "s", 0), (4, "one two three four five six", "en", "s", 0),
    (5, "one  two three\nfour five six", "en", "t", 0), (None, "one two three four five six", "en", "t", 0), (6, "x", None, "t", 0), (7, "éa ß漢字 <|endoftext|> 12345 'll", "de", None, 0),
    (8, "word " * 3000, "en", "t", 0), (9, "a b c " * 40, "en", "t", 0),
]


def text(n, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice("abé ñ'st\n  Σß漢字🙂́1<|endoftext|>\x1c\x85\t") for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "k", 1, "x", 2, 3) for r in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return con


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def tik(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_bpe_equals_library(encoder, tik):
    whole = bpe.TextEncoder(encoder)
    texts = [text(n % 90, n) for n in range(1500)] + ["a" * 3000, " " * 500, "ab" * 700, "a  b", " 's", "\n\na b\n\n", "a \nb", ""]
    for t in texts:
        ids = tik.encode_ordinary(t)
        assert encoder.encode(t) == ids
        assert whole(t) == np.array(ids, "<u4").tobytes()
        assert encoder.decode(ids) == t.encode()


def test_bpe_judges_pairs_without_merging_them(monkeypatch):
    own = bpe.PrefixEncoder(bpe.read_ranks(RANKS), P.PATTERN)
    rnd = random.Random(2)
    words = ["".join(rnd.choice(["th", "ing", "tion", "an", "e", "r", "eau", "é", "ß"]) for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    pairs = [(rnd.randrange(own.size), rnd.randrange(own.size)) for _ in range(3000)]
    for word in words:
        raw = word.encode()
        pairs += [(own.ranks[raw[:c]], own.ranks[raw[c:]]) for c in range(1, len(raw)) if raw[:c] in own.ranks and raw[c:] in own.ranks]
    pairs = [p for p in pairs if p[0] in own.tokens and p[1] in own.tokens]
    want = [own.merged(own.tokens[a] + own.tokens[b]) == [a, b] for a, b in pairs]
    assert 0 < sum(want) < len(want) and [own._adjacent(a, b) for a, b in pairs] == want
    merged = []
    monkeypatch.setattr(own, "merged", lambda piece: merged.append(piece))
    own._pairs.clear()
    assert [own._adjacent(a, b) for a, b in pairs] == want and not merged


def test_bpe_odd_vocabulary():
    # "abc" ranks before "ab" and "bc", of which one would have to come first: no merging gives it, and pairs with it are judged by merging.
    ranks = {bytes([k]): k for k in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"aa": 259, b"aaa": 260}
    odd, rnd = bpe.PrefixEncoder(ranks, P.PATTERN), random.Random(4)
    for n in range(300):
        piece = "".join(rnd.choice("abc") for _ in range(n % 30 + 1)).encode()
        assert odd.ids_from(odd.extend(piece, [])) == odd.merged(piece)


def test_bpe_remembers_a_word_once(encoder, tik):
    whole = bpe.TextEncoder(encoder)
    text = "zqthear x zqthear zqthear, zqthear.\nzqthear éabzq"
    assert whole(text) == np.array(tik.encode_ordinary(text), "<u4").tobytes()
    assert "zqthear" in whole.stretches and " zqthear" not in whole.pieces and " éabzq" not in whole.pieces


def test_bpe_edits(encoder, tik):
    rnd = random.Random(1)
    for k in range(120):
        live = bpe.EditableText(encoder, text(60, k))
        for _ in range(4):
            i = rnd.randint(0, len(live.text))
            live.replace(i, min(len(live.text), i + rnd.choice([0, 1, 3, 9])), text(rnd.randint(0, 5), rnd.random()))
            live.append(text(rnd.randint(0, 3), rnd.random()))
            assert live.ids() == tik.encode_ordinary(live.text)
    live = bpe.EditableText(encoder, "many words " * 500)
    live.replace(2000, 2001, "z")
    assert live.redone < 12


def test_bpe_query(edge, empty, tik):
    for r in bpe.digests(edge, RANKS, P.PATTERN).join(edge.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = np.array(tik.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0
    assert bpe.encode_documents(edge, RANKS, P.PATTERN).filter("NOT round_trip").count() == 0


def test_token_counts(edge, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    model, known = token_counts.WordBpe(WORDS), {}
    texts = [text(n % 120, n) for n in range(800)] + ["z" * 4000, "aaaa bbbb", "ΑΣ ΑΣΑ", "a<|startoftext|>b"]
    assert model.count(texts, known) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for r in token_counts.token_counts(edge, WORDS).join(edge.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)
    assert token_counts.token_counts(empty, WORDS).count() == 0


def same(df, found):
    key = lambda rows, names: sorted((tuple(r[i] for i in sorted(range(len(names)), key=lambda k: names[k])) for r in rows), key=str)
    assert key(map(tuple, df.collect()), df.columns) == key(found.fetchall(), found.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("operator, oracle", [(mixing.mix, mixing.ORACLE), (rules.quality_rules, rules.ORACLE)])
def test_edge_rows_against_oracle(edge, operator, oracle):
    con, edge = duckdb.connect(), edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    con.register("documents", edge.toArrow())
    same(operator(edge), con.sql(oracle))


def test_repeated_rows_are_repeated(edge):
    rows = [tuple(r) for r in rules.quality_rules(edge).filter("doc_id = 4").collect()]
    assert len(rows) == 2 and rows[0] == rows[1]
    rows = [tuple(r) for r in mixing.mix(edge).filter("doc_id = 4").collect()]
    assert len(rows) == 2 and sum(r[1] for r in rows) == 12


def test_empty_tables(spark, empty):
    assert mixing.mix(empty).count() == 0
    assert rules.quality_rules(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert langid.language_id(empty).count() == 0
    assert lm.score_documents(empty, RANKS, P.PATTERN).count() == 0
    assert quality.classify(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_mix_targets(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target, size = collections.Counter(), {}, sum(r["size"] for r in rows)
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * size) < 1e-6 * size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_mix_repeats_and_cuts(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "x"), (3, None, "x")], "doc_id long, text string, source string")
    mixed = spark.createDataFrame([(1, 3, 5), (2, 2, 0), (3, 0, 0)], "doc_id long, size long, taken long").join(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key")), "doc_id")
    assert sorted((r["doc_id"], r["text"]) for r in mixing.repeated(docs, mixed).collect()) == [(1, "a b"), (1, "a b c"), (3, None)]


def test_mix_rows_that_share_an_identifier(spark):
    """Rows go by their own text; rows alike in all three are taken as often as all of them together."""
    rows = [(None, " ".join(f"a{k}" for k in range(60)), "x"), (None, "b c", "x"), (7, "d e f", "x"), (7, "g", "x"), (8, "h i", "y"), (8, "h i", "y"), (8, "h i", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.placed_rows(docs)
    found, taken = collections.Counter(), collections.Counter()
    for r in mixing.repeated(docs, placed).collect():
        found[r["doc_id"], r["source"]] += len(r["text"].split())
    for r in placed.collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    assert found == +taken


def test_exact_edges(edge):
    rows = exact_dedup.exact_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    six = [r for r in rows if r["keep_id"] == 4]
    assert len(six) == 4 and [r["group_size"] for r in six] == [4] * 4 and sum(r["kept"] for r in six) == 1
    assert {r["doc_id"]: r["keep_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1: 1, 2: 1, 3: 3}
    assert exact_dedup.without_duplicates(edge).count() == len({re.sub(r"[ \t-\r]+", " ", r[1] or "") for r in EDGE})


def test_exact_collisions_are_told_apart(docs, duck):
    weak = exact_dedup.exact_duplicates(docs, lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1))
    same(weak, duck.sql(exact_dedup.ORACLE))


def test_exact_collisions_keep_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, "a")], "doc_id long, text string")
    for digest in (exact_dedup.sha256, lambda t: F.unhex(F.lit("00"))):
        found = sorted((tuple(r) for r in exact_dedup.exact_duplicates(rows, digest).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
        assert found == sorted([(1, 1, 3, True), (1, 1, 3, False), (2, 2, 1, True), (3, 1, 3, False), (None, None, 2, True), (None, None, 2, False)], key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_second_batch(spark, tmp_path, weak):
    """A ledger that lasts holds a further batch against the first one, by bytes that it locates in the first one's files."""
    digest = (lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1)) if weak else exact_dedup.sha256
    tables = []
    for k, rows in enumerate(([(10, "a  b"), (11, "c"), (12, "c"), (13, None)], [(5, "a b"), (20, "c"), (21, "d"), (22, ""), (23, "d")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/t{k}")
        tables.append(exact_dedup.exact_duplicates(spark.read.parquet(f"{tmp_path}/t{k}"), digest, path=f"{tmp_path}/ledger").collect())
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in tables[0]} == {10: (10, 1, True), 11: (11, 2, True), 12: (11, 2, False), 13: (13, 1, True)}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in tables[1]} == {5: (5, 2, True), 20: (11, 3, False), 21: (21, 2, True), 22: (13, 2, False), 23: (21, 2, False)}


def brute_components(texts, width, percent):
    sets = {i: near_dedup.shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_equals_brute_force(docs, width):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, width).collect()}
    assert found == brute_components(texts, width, 80)


def test_near_loose_families(spark, monkeypatch):
    """A family of copies that differ so much that pivots alone leave it apart; small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6000)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(90):
        mine = list(base)
        for _ in range(rnd.choice([1, 4, 7, 10, 14])):
            mine[rnd.randrange(120)] = f"v{rnd.randrange(10**6)}"
        texts[i] = " ".join(mine)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 2).collect()}
    assert found == brute_components(texts, 2, 80)


@pytest.mark.parametrize("hot", [0, 6])
def test_near_hot_keys(spark, monkeypatch, hot):
    """All classes, band keys and centres count as hot, or only the commonest; copies, near copies, empty texts and rows without identifier."""
    monkeypatch.setattr(workspace, "HOT_ROWS", hot)
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    base = [fresh(80) for _ in range(4)]
    texts = {}
    for i in range(80):
        mine = list(base[i % 4]) if i % 9 else fresh(30)
        if i % 3 == 0:
            mine[rnd.randrange(len(mine))] = f"v{rnd.randrange(10**6)}"
        texts[i] = " ".join(mine)
    texts |= {i: "" for i in range(80, 100)}
    df = spark.createDataFrame([*texts.items(), (None, texts[1]), (None, None), (None, "")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df, 2).collect()
    assert len(rows) == 103 and all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == brute_components(texts, 2, 80)


def test_near_edges(edge):
    rows = near_dedup.near_duplicates(edge, 2).collect()
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[6]["n_shingles"] == 1 and by[5]["component_id"] == 4 and not by[5]["kept"]


def test_near_rows_that_share_an_identifier(spark):
    """Each row is linked by its own text, whatever its identifier, and one row of each group stays."""
    x, y = ([f"{c}{k}" for k in range(100)] for c in "xy")
    rows = [(1, " ".join(x)), (1, " ".join(y)), (2, " ".join([*x, "z"])), (3, " ".join([*y, "z"])), (4, " ".join(y)), (4, " ".join(y)), (None, " ".join(x)), (6, " "), (6, " ")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, node int")
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 2).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False), (None, None, True), (6, 6, True), (6, 6, True)], key=str)
    left = [(r["doc_id"], r["text"][0]) for r in near_dedup.without_near_duplicates(docs, 2).collect()]
    assert sorted(left, key=str) == sorted([(1, "x"), (1, "y"), (None, "x"), (6, " "), (6, " ")], key=str)
    twins = docs.filter("doc_id = 4").unionByName(docs.filter("doc_id = 3"))
    assert [r["doc_id"] for r in near_dedup.without_near_duplicates(twins, 2).collect()] == [3]
    assert near_dedup.without_near_duplicates(docs.filter("doc_id = 4"), 2).count() == 1


def test_components_of_hot_nodes(spark, monkeypatch):
    """A centre with most links, and chains beside it, whether its neighbours count as hot or not."""
    pairs = [(5000, k) for k in range(1000, 1400)] + [(k, 10) for k in range(1390, 1500)] + [(k, k + 1) for k in range(100, 130)]
    for rows in (256, 3, 10**9):
        monkeypatch.setattr(workspace, "HOT_ROWS", rows)
        found = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        assert found == {k: 10 for k in [5000, *range(1000, 1500)]} | {k: 100 for k in range(101, 131)}


def test_join_hot(spark, monkeypatch):
    """Hot or not, each row meets its key's; those without one go, or have nulls."""
    rows = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 0), (3, 1), (None, 2)], "key int, x int")
    of = spark.createDataFrame([(1, "a", 9), (2, None, 1)], "key int, y string, __cw_n long")
    for least in (0, 4, 99):
        monkeypatch.setattr(workspace, "HOT_ROWS", least)
        inner = [(1, k, "a") for k in range(9)] + [(2, 0, None)]
        assert sorted(map(tuple, workspace.join_hot(rows, of, "key", 12).collect()), key=str) == sorted(inner, key=str)
        assert sorted(map(tuple, workspace.join_hot(rows, of, "key", 12, "left").collect()), key=str) == sorted([*inner, (3, 1, None), (None, 2, None)], key=str)


def test_near_joins_stay_out_of_the_driver(spark, monkeypatch):
    """Tables that grow with the rows are shuffled, however small Spark takes them to be."""
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        pairs = spark.createDataFrame([(2, 1), (3, 1)], "u long, v long")
        of = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"c")], "node long, sketch binary")
        beside = near_dedup._beside(pairs, of, "sketch")
        assert plan(beside).count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan(beside)
        hot = workspace.join_hot(pairs, pairs.select("u", F.lit(1).alias("m"), F.lit(1).alias("__cw_n")), "u", 2)
        assert plan(hot).count("SortMergeJoin") == 1
        found = {}
        settle = near_dedup.settle
        monkeypatch.setattr(near_dedup, "settle", lambda df, label: (found.__setitem__(label, plan(df)), settle(df, label))[1])
        near_dedup.near_duplicates(spark.createDataFrame([(1, "a b c d"), (2, "a b c d e"), (3, "x")], "doc_id long, text string"), 2, 50).collect()
        for label, bitmaps in {"sketches": 1, "texts": 1, "placed": 0, "loose": 0, "linked": 0}.items():
            assert "SortMergeJoin" in found[label] and found[label].count("BroadcastHashJoin") == bitmaps, label
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components(spark):
    pairs = [(a, a + 1) for a in range(1, 30)] + [(50, 40), (40, 60), (60, 50), (40, 50), (70, 70), (None, 1)]
    found = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {**{k: 1 for k in range(2, 31)}, 50: 40, 60: 40}


def test_language_held_out(spark):
    rows = langid.language_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) > 0.97 * len(out)


def test_language_mixture():
    rng = np.random.default_rng(0)
    likelihood = rng.dirichlet(np.full(langid.BINS, 0.02), 3).T + 1e-7
    likelihood /= likelihood.sum(axis=0)
    draw = lambda k, n: rng.choice(langid.BINS, n, p=likelihood[:, k])
    share = langid.mixture(np.concatenate([draw(0, 3000), draw(2, 1000)]), likelihood)
    assert abs(share[0] - 0.75) < 0.03 and share[1] == 0 and abs(share.sum() - 1) < 1e-9
    assert langid.mixture(draw(1, 500), likelihood)[1] == 1.0


def test_language_mixture_equals_plain_estimation():
    """Against expectation-maximisation written out word by word and run to its end, with every order of leaving languages out."""
    rng = np.random.default_rng(5)
    likelihood = rng.dirichlet(np.full(langid.BINS, 0.05), 3).T + 1e-6
    likelihood /= likelihood.sum(axis=0)
    for weights, n in (((0.5, 0.5, 0), 900), ((0.2, 0.3, 0.5), 2500), ((0, 0, 1), 300), ((0.9, 0.1, 0), 60)):
        bins = np.concatenate([rng.choice(langid.BINS, int(w * n), p=likelihood[:, k]) for k, w in enumerate(weights) if w])

        def plain(chosen, bins=bins):
            p = {k: 1 / len(chosen) for k in chosen}
            for _ in range(3000):
                new = dict.fromkeys(chosen, 0.0)
                at = sum(p[k] * likelihood[bins, k] for k in chosen)
                for k in chosen:
                    new[k] = float(np.mean(p[k] * likelihood[bins, k] / at))
                p = new
            return p, float(np.sum(np.log(sum(p[k] * likelihood[bins, k] for k in chosen))))

        chosen = [0, 1, 2]
        p, fit = plain(chosen)
        while len(chosen) > 1:
            rest = [k for k in chosen if k != min(chosen, key=p.get)]
            fewer, less = plain(rest)
            if fit - less > langid.PENALTY * np.log(len(bins)):
                break
            chosen, p, fit = rest, fewer, less
        assert np.allclose(langid.mixture(bins, likelihood), [p.get(k, 0) for k in range(3)], atol=2e-3)


def test_language_edges(edge):
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(edge).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] in ("en", "de")


def test_lm_gradient():
    rng = np.random.default_rng(0)
    start = lm.Weights.initial()
    dense, tables = ({k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in part.items()} for part in (start.dense, start.tables))
    model = lm.Attention(lm.Weights(dense, tables, start.seen))
    windows, goals = rng.integers(0, lm.VOCAB, (3, 2 * lm.STRIDE)).astype(np.int32), rng.integers(0, lm.VOCAB, (3, lm.STRIDE)).astype(np.int32)
    windows[0, : lm.STRIDE], goals[1, 5:] = lm.PAD, lm.PAD
    _, slope, touched = model.gradient(windows, goals)
    whole = dict(slope)
    for k, (rows, found) in touched.items():
        whole[k] = np.zeros(tables[k].shape)
        whole[k][rows] = found
    for k, found in whole.items():
        array = dense[k] if k in dense else tables[k]
        at = np.unravel_index(np.abs(found).argmax(), found.shape)
        old, values = array[at], []
        for step in (1e-4, -1e-4):
            array[at] = old + step
            values.append(model.gradient(windows, goals)[0])
        array[at] = old
        assert abs((values[0] - values[1]) / 2e-4 - found[at]) < 1e-3 * max(0.01, abs(found[at])), k


def test_lm_sums_by():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        key, rows = rng.integers(0, 40, n).astype(np.uint16) ** 2, rng.normal(size=(n, 5))
        ids, found = lm.sums_by(key, rows)
        assert ids.tolist() == sorted(set(key.tolist()))
        assert np.allclose(found, [rows[key == i].sum(axis=0) for i in ids])


def test_lm_probabilities_sum_to_one():
    model = lm.Attention(lm.Weights.initial())
    state = np.random.default_rng(1).normal(size=(1, lm.WIDTH)).astype(np.float32)
    logs = model.head(np.repeat(state, lm.VOCAB, axis=0), np.arange(lm.VOCAB))[0]
    assert abs(np.exp(logs.astype(np.float64)).sum() - 1) < 1e-4


def test_lm_packs_and_averages():
    start, one, two = (lm.Weights.initial(seed) for seed in (1, 2, 3))
    back = lm.Weights.unpack(one.pack())
    assert all(np.allclose(back.tables[k], one.tables[k], atol=2e-3) for k in lm.TABLES) and all((back.dense[k] == one.dense[k]).all() for k in lm.DENSE)
    gains = [{k: np.zeros(s[0]) for k, s in lm.TABLES.items()} for _ in range(2)]
    gains[0]["own"][7], gains[1]["own"][7], gains[1]["two"][5] = 1, 3, 2
    mean = lm.Mean(start)
    mean.add(10.0, one, gains[0])
    mean.add(30.0, two, gains[1])
    found = mean.result()
    assert np.allclose(found.dense["wg"], 0.25 * one.dense["wg"] + 0.75 * two.dense["wg"])
    assert np.allclose(found.tables["own"][7], 0.25 * one.tables["own"][7] + 0.75 * two.tables["own"][7])
    assert (found.tables["two"][5] == two.tables["two"][5]).all() and (found.tables["own"][8] == start.tables["own"][8]).all()


def plain_log10(w, ids):
    """log10 probability of a text's ids (the end mark last), one token at a time by the formulas."""
    stream, total = [lm.END, *ids[:-1]], 0.0
    exp = lambda z: np.exp(z.astype(np.float64))
    for i, goal in enumerate(ids):
        first = max(0, (i // lm.STRIDE - 1) * lm.STRIDE)
        window = np.array([[lm.PAD] * (2 * lm.STRIDE - 1) + [lm.END] + stream[: i + 1]])[:, -2 * lm.STRIDE :]  # only for the hashes of the last three
        own = w.tables["own"][stream[i]]
        near = [w.tables["context"][stream[j]] for j in range(first, i + 1)]
        share = exp(np.array([own[lm.WIDTH :] @ c[lm.WIDTH :] + w.dense["r"][i - first - j] for j, c in enumerate(near)]))
        share /= share.sum()
        last = [lm.PAD, lm.PAD, *stream[first : i + 1]][-3:]
        window[0, -3:] = last
        two, three = (h[-1] for h in lm.hashed(window))
        state = own[: lm.WIDTH] + sum(s * c[: lm.WIDTH] for s, c in zip(share, near)) + w.tables["two"][two] + w.tables["three"][three]
        outer = exp(state @ w.dense["wg"] + w.dense["bg"])
        g, m = divmod(int(goal), lm.MEMBERS)
        inner = exp(state @ w.dense["wm"][g] + w.dense["bm"][g])
        total += np.log10(outer[g] / outer.sum()) + np.log10(inner[m] / inner.sum())
    return total


def test_lm_scores(docs, monkeypatch):
    packed = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: packed.append(train(*a)) or packed[0])
    rows = lm.score_documents(docs, RANKS, P.PATTERN).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    counts = collections.Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    weights, words = lm.Weights.unpack(packed[0][0]), lm.Words(lm.encoding(RANKS, P.PATTERN))
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t))
        if len(t) < 300:
            assert r["score"] == pytest.approx(plain_log10(weights, words.tokens(*words.numbers([t[:-1]]))[0].tolist()), rel=1e-4)


def test_lm_windows_cover_every_text():
    words = lm.Words(lm.encoding(RANKS, P.PATTERN))
    texts = [t.encode().split() for t in ("", "one two", "word " * 300, " ".join(f"w{k % 97}x{k}" for k in range(5000)))]
    tokens, sizes = words.tokens(*words.numbers(texts))
    windows, goals = lm.blocks(tokens, sizes)
    assert goals[goals != lm.PAD].tolist() == tokens.tolist()
    at = np.cumsum(-(-sizes // lm.STRIDE))
    for a, b, begin, size in zip(np.append(0, at), at, np.cumsum(sizes) - sizes, sizes):
        stream = [lm.END, *tokens[begin : begin + size - 1]]
        inputs = windows[a:b, lm.STRIDE :].ravel()
        assert inputs[inputs != lm.PAD].tolist() == stream and (windows[a, : lm.STRIDE] == lm.PAD).all() and (windows[a + 1 : b, : lm.STRIDE] == windows[a : b - 1, lm.STRIDE :]).all()
    tik = [words.encoder.encode_ordinary(" " + w.decode()) for w in texts[1]]
    assert (tokens[sizes[0] : sizes[0] + sizes[1] - 1] - 1).tolist() == sum(tik, [])


def test_lm_encodes_new_words_together():
    encoder, calls = lm.encoding(RANKS, P.PATTERN), []

    class Counted:
        n_vocab, decode_single_token_bytes = encoder.n_vocab, staticmethod(encoder.decode_single_token_bytes)

        def encode_ordinary(self, text):
            calls.append(text)
            return encoder.encode_ordinary(text)

    plain = [w.encode() for w in ("don't", "'s", "a,b", "###", "12ab", "äöü", "日本", "x" * 300, "\x00", "é'll", *(f"w{k * 7919 % 1009}" for k in range(500)))]
    for more, most in (([], 1), (["no\u00a0break", "\u3000", "end\u2028", "a\u00a0\u00a0b"], 2000)):
        texts, words = [plain[:7], [], plain + [w.encode() for w in more]], lm.Words(Counted())
        calls.clear()
        tokens, sizes = words.tokens(*words.numbers(texts))
        assert len(calls) <= most
        expected = [[k + 1 for w in t for k in encoder.encode_ordinary(" " + w.decode())] + [lm.END] for t in texts]
        assert tokens.tolist() == sum(expected, []) and sizes.tolist() == list(map(len, expected))


def test_lm_training_steps_need_no_new_pages():
    memory.reuse_freed()
    rng, learner = np.random.default_rng(0), lm.Learner(lm.Weights.initial(), 0.02, 11)
    parts = [rng.integers(0, lm.VOCAB, (lm.BATCH, 3 * lm.STRIDE)).astype(np.int32) for _ in range(15)]
    for k, part in enumerate(parts):
        if k == 5:
            before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        learner._step(part[:, : 2 * lm.STRIDE], part[:, 2 * lm.STRIDE :])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 10 * 300
    memory.trim()


def test_lm_output_in_parts_of_a_group(monkeypatch):
    rng = np.random.default_rng(2)
    model = lm.Attention(lm.Weights.initial())
    state, targets = rng.normal(size=(700, lm.WIDTH)).astype(np.float32), rng.integers(0, 3 * lm.MEMBERS, 700)
    whole = model.head(state, targets, learn=True)
    monkeypatch.setattr(lm, "ROWS", 9)
    for a, b in zip(whole[:3], model.head(state, targets, learn=True)[:3], strict=True):
        assert np.allclose(a, b, atol=1e-5)
    for k, slope in model.head(state, targets, learn=True)[3].items():
        assert np.allclose(slope, whole[3][k], atol=1e-3), k


def test_lm_results_do_not_depend_on_the_bounded_list(docs, monkeypatch):
    monkeypatch.setattr(lm, "RATES", (0.02,))
    whole = {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm.score_documents(docs, RANKS, P.PATTERN).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 5)
    monkeypatch.setattr(lm, "WORDS_KEPT", 300)
    for r in lm.score_documents(docs, RANKS, P.PATTERN).collect():
        assert (r["score"], r["base_score"], r["n_known"]) == pytest.approx(whole[r["doc_id"]])


def test_lm_beats_the_base_on_held_out_texts(spark):
    rows = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), RANKS, P.PATTERN).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)


def test_lm_edges(edge):
    rows = lm.score_documents(edge, RANKS, P.PATTERN).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_tokens"], round(r["score"], 4), round(r["base_score"], 6)))
    assert len(rows) == len(EDGE) and by[1] == by[2] == by[3] and by[4] == by[None] and len(by[4]) == 1 and {n for n, *_ in by[8]} == {3001}


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grades = quality.graded(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = quality.train(docs, grades.filter("crc32(CAST(doc_id AS STRING)) % 3 <> 0"))
    assert np.all(np.diff(model[1]) >= 0)
    held = grades.filter("crc32(CAST(doc_id AS STRING)) % 3 = 0")
    rows = quality.score(docs, model).join(held, "doc_id").collect()
    assert sum(r["kept"] == (r["grade"] == 2) for r in rows) > 0.85 * len(rows)
    clean = [r for r in rows if r["grade"] == 2]
    assert sum(r["kept"] for r in clean) > 0.95 * len(clean)


def test_quality_edges(spark, edge):
    none = quality.classify(spark, edge, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(EDGE) and all(r["kept"] for r in none)
    some = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (9, 0, 0), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(spark, edge, some).count() == len(EDGE)


def test_quality_fit_follows_the_likelihood():
    """The fitted model is better than its neighbours in a plain ordinal likelihood, and orders its thresholds."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(900):
        bins = rng.choice(40, 6, replace=False).astype(np.int32)
        z = float(sum(0.4 if b < 20 else -0.4 for b in bins)) + rng.logistic()
        rows.append((int(z > -0.8) + int(z > 0.9), bins, np.ones(6, np.float32)))
    weight, cut = quality.fit(rows)

    def loss(w, t):
        total = 0.0
        for g, bins, values in rows:
            tails = [1.0, *(1 / (1 + np.exp(-(float(w[bins] @ values) - x))) for x in t), 0.0]
            total -= np.log(tails[g] - tails[g + 1])
        return total / len(rows)

    here = loss(weight, cut)
    assert cut[0] < cut[1] and here < loss(0 * weight, cut) - 0.05
    assert weight[:20].mean() > 0.15 and weight[20:40].mean() < -0.15
    for shift in (np.array([0.4, 0]), np.array([0, 0.4])):
        assert loss(weight, cut + shift) > here and loss(weight, cut - shift) > here
    # Descent on all rows to the end: the fit, which stops early and averages, comes near its likelihood.
    x = np.zeros((len(rows), 40))
    for k, (_, bins, values) in enumerate(rows):
        x[k, bins] = values
    g, w, t = np.array([r[0] for r in rows]), np.zeros(40), np.array([-1.0, 1.0])
    for _ in range(1500):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        tails = np.column_stack([np.ones(len(g)), above, np.zeros(len(g))])
        low, high = tails[np.arange(len(g)), g], tails[np.arange(len(g)), g + 1]
        w += 2 * x.T @ (1 - low - high) / len(g)
        edge = above * (1 - above) / (low - high)[:, None]
        t += 2 * np.array([np.sum(edge[g == k, k]) - np.sum(edge[g == k + 1, k]) for k in range(2)]) / len(g)
    best = loss(np.concatenate([w, np.zeros(len(weight) - 40)]), t)
    assert best <= here < best + 0.04


def test_rules_reject_a_bad_host(spark):
    good, bad = " ".join(f"word{k}" for k in range(60)), "#### " + " ".join(f"word{k} #" for k in range(60))
    rows = [(k, good, "good") for k in range(40)] + [(100 + k, bad if k < 38 else good, "bad") for k in range(40)] + [(200, bad, "small")]
    found = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[k]["kept"] for k in range(40)) and not any(found[100 + k]["kept"] for k in range(40))
    assert not found[100]["base_failed"] and found[100]["host_failed"] == 38
    assert found[139]["kept"] is False and found[139]["base_failed"] is False  # a clean document of a rejected host


def test_rules_where_windows_share_a_hash(docs, duck, monkeypatch):
    monkeypatch.setattr(rules, "window_hash", lambda a, b, c: F.length(a).cast("long") * 1_000_003)
    few = docs.filter("n_chars < 1500")
    con = duckdb.connect()
    con.register("documents", few.toArrow())
    same(rules.quality_rules(few), con.sql(rules.ORACLE))


def plain_depths(calls):
    """Depth of each (conversation, call) by following what it needs, None in a circle or where something is missing."""

    def depth(key, above):
        if key not in calls or key in above:
            return None
        below = [depth((key[0], n), {*above, key}) for n in calls[key]]
        return None if None in below else 1 + max(below, default=-1)

    return {key: depth(key, set()) for key in calls}


def test_chat_against_plain_linking(spark):
    """Generated conversations with chains, circles, missing calls, twins and repeats."""
    rnd = random.Random(6)
    schema = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number"}}}}
    rows, needs, given, answers = [], collections.defaultdict(set), collections.Counter(), collections.Counter()
    for conv in range(25):
        for turn in range(rnd.randint(2, 6)):
            if rnd.random() < 0.5:
                calls = []
                for _ in range(rnd.randint(1, 4)):
                    name, other = f"c{rnd.randint(0, 5)}", f"c{rnd.randint(0, 6)}"
                    argument = {"$ref": other} if rnd.random() < 0.5 else rnd.random()
                    calls.append({"id": name, "name": "f", "arguments": {"a": argument}})
                    needs[conv, name] |= {other} if isinstance(argument, dict) else set()
                    given[conv, name] += 1
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls, "zeta": 1, "alpha": 2})))
            else:
                name = f"c{rnd.randint(0, 7)}"
                answers[conv, name] += 1
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": name, "content": "x"})))
    depths = plain_depths(needs)
    for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schema).collect():
        body = json.loads(next(t for c, n, _, t in rows if (c, n) == (r["conv_id"], r["turn"])))
        if r["role"] == "tool":
            key = r["conv_id"], body["tool_call_id"]
            assert r["link"] == ("linked" if key in given else "orphan") and (key not in given or r["at_depth"] == (depths[key] or 0))
            continue
        keys = [(r["conv_id"], c["id"]) for c in body["tool_calls"]]
        order = sorted(range(len(keys)), key=lambda k: (depths[keys[k]] is None, depths[keys[k]] or 0, k))
        want = {"role": "assistant", **body, "tool_calls": [body["tool_calls"][k] for k in order]}
        assert r["message_json"] == chat.canonical(want)
        assert r["valid"] == all(depths[k] is not None and given[k] == 1 for k in keys)
        assert (r["n_calls"], r["n_answered"]) == (len(keys), sum(answers[k] > 0 for k in keys))


def test_memory_is_bounded_and_has_one_owner():
    made = []
    first = memory.held("one", lambda: memory.Memo(lambda k: made.append(k) or "v" * 10, 64 * 400))
    assert [first[k] for k in range(300)] == ["v" * 10] * 300 and first.spent <= first.budget and len(first) < 300
    assert memory.held("one", dict) is first and first["x" * 2000] == "v" * 10 and "x" * 2000 not in first
    assert memory.held("two", list) == [] and memory.held("one", dict) is not first


def test_memory_keeps_what_is_frequent():
    made = []
    table = memory.Memo(lambda k: made.append(k) or "v" * 10, 64 * 400)
    for k in range(2000):
        table[k], table["often"]
    assert made.count("often") == 1 and table.spent <= table.budget // 2 and len(table) + len(table.older) < 300


def test_idle_workers_let_go(monkeypatch):
    monkeypatch.setattr(memory, "IDLE_S", 0.2)
    monkeypatch.setattr(memory, "LOOK_S", 0.05)
    release_at = iter([0.4, 0.0])

    def run(batches):
        memory.held("kept", dict)["x"] = 1
        time.sleep(next(release_at))  # a task that takes long is not idle
        assert memory.held("kept", dict) == {"x": 1}
        yield from batches

    assert list(memory.until_idle(run)(iter([1]))) == [1] and list(memory.until_idle(run)(iter([2]))) == [2]
    time.sleep(0.6)
    assert memory.held("kept", dict) == {}


def test_state_stores_close_soon_after_their_stream(spark, docs):
    exact_dedup.exact_duplicates(docs).count()
    opened = lambda: spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager.getNumRocksDBInstances(True)
    end = time.time() + 25
    while opened() and time.time() < end:
        time.sleep(0.5)
    assert opened() == 0


def test_pipeline_stages_on_edge_rows(spark, edge, empty, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, table in enumerate((edge, empty)):
        now = table
        for n, (_, stage) in enumerate(pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            assert set(table.columns) - {"text"} <= set(now.columns)
            now.write.parquet(f"{tmp_path}/{k}-{n}")
            now = spark.read.parquet(f"{tmp_path}/{k}-{n}")
        assert k == 0 or now.count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(edge.withColumn("ids", F.lit(1)), RANKS, P.PATTERN)


def test_chat(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number"}, "b": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
    calls = lambda *x: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in x]})
    result = lambda i, v: json.dumps({"tool_call_id": i, "content": v})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", calls(("x", "add", {"a": 1.0}), ("y", "add", {"a": {"$ref": "x"}, "b": 2}))), (1, 3, "tool", result("x", 3)), (1, 2, "tool", result("y", 4)),
        (1, 4, "tool", result("zz", 4)), (2, 0, "assistant", calls(("p", "add", {"a": {"$ref": "q"}}), ("q", "add", {"a": {"$ref": "p"}}))), (2, 1, "assistant", calls(("r", "add", {"b": -1}))),
        (None, None, None, None), (3, 0, "assistant", "{bad"),
    ]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schema).collect()
    assert len(found) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in found}
    assert [r["turn"] for r in sorted((r for r in found if r["conv_id"] == 1), key=lambda r: (r["at_turn"], r["is_answer"], r["at_depth"], r["at_place"], r["turn"]))] == [0, 1, 3, 2, 4]
    assert by[1, 3]["link"] == "linked" and by[1, 4]["link"] == "orphan" and not by[1, 4]["valid"]
    assert not by[2, 0]["valid"] and by[2, 1]["problems"] == "$.a: missing; $.b: below the minimum"
    assert by[1, 1]["message_json"].startswith('{"role":"assistant","tool_calls":[{"arguments":{"a":1},"id":"x"') and by[1, 1]["n_answered"] == 2
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), schema).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, quality.graded(labels))
    kept = {r["doc_id"]: r for r in docs.collect() if quality.tail_of(model, r["text"]) >= 0.5}
    first: dict[str, int] = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", kept[i]["text"] or ""), i)
    kept = {i: kept[i] for i in first.values()}
    groups = brute_components({i: r["text"] for i, r in kept.items()}, 5, 80)
    kept = {i: r for i, r in kept.items() if groups[i][1] == i}
    left = spark.createDataFrame([kept[i] for i in sorted(kept)], docs.schema)
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(left).collect()}
    rows = collections.defaultdict(list)
    for r in pipeline.run(spark, DATA).collect():
        assert r["round_trip"]
        rows[r["doc_id"]].append(r["n_tokens"])
    for i, (size, n) in taken.items():
        assert len(rows.get(i, [])) == (-(-n // size) if size else 1)
    assert set(rows) <= set(kept)
