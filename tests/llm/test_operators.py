"""The training-data operators against brute force, and their edge cases."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelhouse import llm
from reelhouse.llm import (bench_join, best_fit, clusters, fuzzy_lines, host_reputation, language_mix, ngram_join, pii_spans,
                           repeated_spans, sampled_shards, topk_search, words)

from ..conftest import SF_SMALL

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _oracle(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = llm.queries()[name](spark, SF_SMALL)
    cols, want = _oracle(llm.oracle_sql()[name], SF_SMALL)
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want)


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "word", "a b", "same text of five words here", "same text of five words here", "x" * 50_000,
       "1" * 30_000, "w " * 5_000, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600 ok"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of odd rows, and of none, with extra columns whose names could clash."""
    made = {}
    for kind, texts in (("odd", ODD), ("none", [])):
        d = str(tmp_path_factory.mktemp(kind))
        docs = _docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("id", F.lit("x")).withColumn("h", F.lit(2.0))
        if texts:
            docs = docs.union(docs.filter("doc_id = 5")).union(docs.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
        docs.write.parquet(f"{d}/documents.parquet")
        n = 8 if texts else 0
        items = [("7", "same text of five words here"), ("8", None), ("9", ""), ("10", "ok")][:n]
        spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://b.co.uk", "x://h.org/fr/#t", "x://h.org/fr/#t", "://"][:n]
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame([(3, 0, None), (3, 1, 1), (None, 0, 0)][:n], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        vecs = [(0, [0.5, -0.25]), (50, [0.5, -0.25]), (50, [0.1, 0.2]), (3, [1e30, 1.0]), (4, None), (5, [float("nan"), 1.0]),
                (6, [None, 1.0]), (None, [1.0, 1.0])][:n]
        spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
        made[kind] = d
    return made


@pytest.mark.parametrize("kind", ["odd", "none"])
@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_odd_rows(spark, sf, name, kind):
    rows = llm.queries()[name](spark, sf[kind]).collect()
    if kind == "none":
        assert rows == []
    elif name.split("_")[0] in ("op1", "op2", "op3", "op5", "op6", "op7", "op8"):
        assert len(rows) == len(ODD) + 2


def test_word_hashes_tell_windows_apart():
    w = words.split_words([b"a b c a b c", None, b"a b"], words.NOT_SPACE)
    h = words.windows_hash(w.h[0], 3)
    assert h[0] == h[3] and len(set(h[:3].tolist())) == 3
    assert words.within(w.doc, 2).tolist() == [0, 1, 2, 3, 4, 6]
    assert [w.word(i) for i in range(3)] == [b"a", b"b", b"c"]


def test_long_runs_stay_linear(spark):
    text = "9" * 200_000 + " " + "a" * 200_000 + "@ " + "1.2." * 50_000
    assert pii_spans.find_spans(_docs(spark, [text])).select(F.size("spans")).first()[0] == 25_000  # the addresses


def test_iban_and_context(spark):
    d = pii_spans.find_spans(_docs(spark, ["iban GB82 WEST 1234 5698 7654 32.", "GB83WEST12345698765432"]))
    got = [r.spans for r in d.orderBy("doc_id").collect()]
    assert any(s.kind == 4 and s.score == pytest.approx(0.95) for s in got[0]) and not any(s.kind == 4 for s in got[1])


def test_secrets_need_a_word_nearby(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e"
    texts = [f'token = "{key}"', f"see {key} there", "token " + "ab1" * 12, "token abcdefghijklmnopqrstuvwxyz", f"{key} {'x ' * 30} token", f"KEY_{key}"]
    docs = _docs(spark, texts).withColumn("__pii_text", F.lit("mine")).withColumn("__m_ip", F.lit(7))
    got = pii_spans.find_spans(docs).orderBy("doc_id").collect()
    assert [[(s.start, s.end) for s in r.spans if s.kind == 5] for r in got] == [[(9, 41)], [], [], [], [], []]
    assert got[0].spans[0].score == pytest.approx(0.55) and {(r["__pii_text"], r["__m_ip"]) for r in got} == {("mine", 7)}


def test_bytes_law_and_slots(spark):
    texts = ["copy " * 200] * 300 + [f"text {i} " * (i % 50) for i in range(3000)]
    docs = _docs(spark, texts).select(F.col("doc_id").alias("own"), F.length("text").cast("long").alias("size"), F.xxhash64("text").alias("k"))
    got = sampled_shards.shard_by_bytes(docs.withColumn("size", F.col("size") + 1), "k", "size", "own").toPandas()
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 8 and per.max() - per.min() < 0.02 * per.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_search_prunes_exactly():
    rng = np.random.default_rng(1)
    c = np.floor(rng.normal(size=(64, 500)) * 40)
    q = np.floor(rng.normal(size=(64, 20)) * 40)
    alive, s = topk_search.pair_scores(q, c, np.full(20, -np.inf), 5, np.zeros((20, 500), bool))
    full = (q.T @ c).astype(np.int64)
    for i in range(20):
        assert sorted(s[i], reverse=True)[:5] == sorted(full[i], reverse=True)[:5]


def test_tokens_equal_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[0] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    texts += ["it's  a\n\n tab\t \u00a0x 12ab  ", "  ", "a<|endoftext|>b", "\u4e2d\u6587 \u0661\u0662 \U0001f600\u200d"]
    got = {(r.doc_id, r.piece): r for r in best_fit.token_pieces(_docs(spark, texts)).collect()}
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            r = got.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert not got


def test_packing_fills_sequences(spark):
    got = llm.queries()["op10_best_fit"](spark, SF_SMALL).toPandas()
    assert got["length"].max() <= 1024 and not got.duplicated(["doc_id", "piece"]).any()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 2


def test_local_search_empties_sequences():
    plan = best_fit.Counter({((6, 1),): 1, ((5, 1),): 1, ((4, 1), (3, 1)): 1, ((2, 1),): 1})
    better = best_fit.local_search(plan, 10)
    assert sum(better.values()) == 2
    count = best_fit.Counter()
    for f, n in better.items():
        for length, each in f:
            count[length] += n * each
    assert count == {6: 1, 5: 1, 4: 1, 3: 1, 2: 1}


def test_local_search_goes_on_to_the_end():
    plan = best_fit.Counter({((1, 25_000),): 1, ((1, 25_001),): 1})  # a piece moves at a time
    assert best_fit.local_search(plan, 60_000) == {((1, 50_001),): 1}


def test_languages_on_held_out_rows(spark):
    got = llm.queries()["op1_language_mix"](spark, "/root/testdata/sf0.01")
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    ok = got.filter("held_out").join(true, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert ok > 0.98


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model = language_mix.learn(docs)
    one = {r.lang: r.t for r in docs.filter("n_chars > 2000").groupBy("lang").agg(F.first("text").alias("t")).collect()}
    mixed = _docs(spark, [one["en"][:1500] + " " + one["de"][:1500], "7f3a9c 0x81 ;;;; 99182 q"])
    rows = language_mix.predict(mixed, langs, model, keep=("doc_id",)).orderBy("doc_id").collect()
    assert {m.lang for m in rows[0].mixture} >= {"en", "de"} and all(abs(m.share - 0.5) < 0.1 for m in rows[0].mixture[:2])


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(clusters.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def _kept_by_all_shingles(docs, size=8, percent=80):
    """Document -> text left, every distinct line against every other by all its overlapping shingles."""
    first = {}
    for i, t in sorted(docs):
        for p, x in enumerate(t.split("\n")):
            if x.strip():
                first.setdefault(x, (i, p))
    sets = {x: frozenset(x[k:k + size] for k in range(max(1, len(x) - size + 1))) for x in first}
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_first = sorted(first, key=first.get)
    for i, x in enumerate(by_first):
        for y in by_first[:i]:
            c = len(sets[x] & sets[y])
            if 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c):
                a, b = sorted((find(x), find(y)), key=first.get)
                root[b] = a
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or first[find(x)] == (i, p)) for i, t in docs}


def test_near_lines_by_all_character_shingles(spark):
    """The small documents, and lines of a script without blanks, by the whole definition."""
    rng = np.random.default_rng(5)
    docs = [(r[0], r[1] or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    for script in ((0x4E00, 0x9000), (0x1F600, 0x1F640), (0x61, 0x7B)):  # Chinese, beyond 16 bits, one long word
        for n in (60, 120, 400):
            line = [chr(c) for c in rng.integers(*script, n)]
            near = line[:]
            near[n // 3] = "#"
            docs += [(100_000 + len(docs), "".join(line)), (100_000 + len(docs) + 1, "".join(near))]
    for k in range(40):  # two characters of a line changed: most lose a fifth of the shingles at word starts
        line = " ".join("".join(chr(c) for c in rng.integers(0x61, 0x7B, int(m))) for m in rng.integers(2, 12, 22))
        near = line[:40] + "#" + line[41:90] + "#" + line[91:]
        docs += [(200_000 + len(docs), line), (200_000 + len(docs) + 1, near)]
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCS)
    got = {r.doc_id: r.text for r in fuzzy_lines.drop_surplus_lines(made).collect()}
    want = _kept_by_all_shingles(docs)
    assert got == want and sum(want[i] == "" for i in want if i >= 100_000) >= 30


@pytest.mark.parametrize("k", [2, 10, 40])
def test_band_recall_at_four_fifths(spark, k):
    """Pairs of sets of 9 k elements, similar by exactly 0.8: how many share a band."""
    rng = np.random.default_rng(k)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, (1000, 10 * k))
    rows = [(i, side, v) for i, x in enumerate(h) for side, v in enumerate((x[:9 * k].tolist(), x[k:].tolist()))]
    each = spark.createDataFrame(rows, "id long, side int, s array<long>").select("id", "side", F.explode("s").alias("h"))
    signed = each.groupBy("id", "side").agg(*fuzzy_lines._orders("h")).select("id", fuzzy_lines._bands().alias("b"))
    found = signed.groupBy("id").agg(F.min("b").alias("x"), F.max("b").alias("y")).filter(F.arrays_overlap("x", "y")).count()
    print("band recall", 9 * k, found / 1000)
    assert found >= 980


def test_signatures_by_runs_are_those_by_shingles(spark):
    """Lines around every border of a run, of several scripts: the bands of all their shingles, one by one."""
    rng = np.random.default_rng(11)
    lines = ["".join(chr(c) for c in rng.integers(*script, n)) for script in ((0x21, 0x7F), (0x4E00, 0x9000), (0x1F600, 0x1F640))
             for n in (*range(1, 3 * fuzzy_lines.RUN + 10), 200, 3001)] + ["a" * 500, "ab " * 300]
    signed = fuzzy_lines._signed(spark.createDataFrame([("\n".join(lines),), (lines[40],), (None,)], "text string"))
    got = {r.l1: r.bands for r in signed.collect()}
    each = [(line, line[i:i + fuzzy_lines.SHINGLE]) for line in lines for i in range(max(len(line) - fuzzy_lines.SHINGLE, 0) + 1)]
    h = spark.createDataFrame(each, "line string, s string").select("line", F.xxhash64(F.encode("s", "UTF-32")).alias("h"))
    want = h.groupBy("line").agg(*fuzzy_lines._orders("h")).select(F.xxhash64("line").alias("l1"), fuzzy_lines._bands().alias("bands"))
    assert got == {r.l1: r.bands for r in want.collect()} and len(got) == len(set(lines))
    rows = spark.createDataFrame([(5, 3), (-7, 9)], "x long, y long")  # several hashes in a row are all in the minima
    flat = rows.select(F.explode(F.array("x", "y")).alias("h")).agg(*fuzzy_lines._orders("h")).first()
    assert rows.agg(*fuzzy_lines._orders("x", "y")).first() == flat


def test_subsets_and_lists_agree(spark, monkeypatch):
    """Light sets by subsets give the components that inverted lists give."""
    rng = np.random.default_rng(3)
    base = [[f"w{j}" for j in rng.integers(0, 500, int(n))] for n in rng.integers(2, 30, 60)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["zz"]) for b in base] + [" ".join([*b, "end"]) for b in base]
    found = []
    for light in (0, 26):
        monkeypatch.setattr(ngram_join, "_boundary", lambda reps, lists, light=light: light)
        found.append(sorted(map(tuple, ngram_join.jaccard_components(_docs(spark, texts)).collect())))
    assert found[0] == found[1] and len({r[2] for r in found[0]}) < len(texts)


def test_rules_and_shrinkage(spark):
    pages = spark.createDataFrame([(i, "http://bad.example.org/x") for i in range(60)] + [(100, "http://new.example.org/"), (101, "http://s.net/"),
                                  (102, "http://a.example.net/en/")] + [(200 + i, f"http://h{i}.fine.com/") for i in range(60)], "page_id long, url string")
    seen = spark.createDataFrame([(i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)], "page_id long, bad int")
    v = {r.page_id: (r.verdict, r.rule) for r in host_reputation.judge_urls(pages, seen).collect()}
    assert v[0] == ("block", None) and v[200] == ("allow", None) and v[101] == ("block", "net/") and v[102] == ("allow", "example.net/en/")


def test_windows_shorter_items_and_borders(spark):
    docs = _docs(spark, ["The QUICK brown fox", "quick brown", "one two three four five six seven eight nine ten eleven twelve"])
    items = spark.createDataFrame([(1, "quick-brown"), (2, "zero one two three four five six seven eight nine ten"), (3, "fox")], "item_id long, text string")
    got = {r.doc_id: sorted((h.start, h.end, h.item_id) for h in r.hits) for r in bench_join.contained_windows(docs, items).collect()}
    assert got == {0: [(1, 3, "1"), (3, 4, "3")], 1: [(0, 2, "1")], 2: [(0, 10, "2")]}


def test_repeats_inside_and_across(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = {r.doc_id: r for r in repeated_spans.remove_repeats(_docs(spark, [a, f"x {a} y", f"{a} {a}"])).collect()}
    assert rows[0].n_removed == 0 and rows[1].kept == "x y" and rows[2].kept == ""


def test_rest_imports_without_llm():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "reelhouse")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read()
