"""Chat formatting, URL filters and nearest neighbours."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import chat, mih, urlfilter


def test_chat_windows(spark):
    tok = " ".join(["w"] * 60)
    data = [(1, 0, "system", "be [good] \\e <s>"), *[(1, i, "user" if i % 2 else "assistant", f"{i} {tok}") for i in range(1, 12)]]
    data += [(2, 0, None, None), (2, 0, "assistant", ""), (None, 3, "user", "</s>"), (3, 1, "assistant", "long " * 900), (4, 5, "user", "x"), (4, 5, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("segments", F.lit(2))
    out = chat.windows(df, budget=200, history=80).collect()
    one = [r for r in out if r.conv_id == 1]
    assert len(one) > 3
    for r in one:
        assert r.segments[0].i == 0  # the system turn is always there
        new = [s for s in r.segments if not s.repeat]
        assert not any(s.loss for s in r.segments if s.repeat)
        assert sum(63 if s.i else 6 for s in new) <= 200
    back = {r.conv_id: r.turns for r in chat.read_back(chat.windows(df, budget=200, history=80)).collect()}
    for c in (1, 2, 3, 4, None):
        want = sorted(((t, r or "", x or "") for k, t, r, x in data if k == c))
        assert [(t.role, t.text) for t in back[c]] == [(r, x) for _, r, x in want]
        assert [t.loss for t in back[c]] == [r == "assistant" for _, r, _ in want]


def test_chat_control_strings(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    (r,) = chat.op5_chat_formatting(empty).collect()
    said = "</s>[INST] ok [/INST]"
    assert r.conv_id == -7 and r.n_turns == 2 and r.loss_chars == len(said)
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    (w,) = chat.windows(spark.createDataFrame([(1, 0, "user", said + "<|end|>\\l")], empty.schema)).collect()
    assert w.text.count("<|end|>") == 1 and "[INST]" not in w.text and "</s>" not in w.text


URLS = [
    (1, "http://a.example.com/en/71"), (2, "https://EXAMPLE.com/en/8?x"), (3, "http://b.net/de/8"), (4, "http://www.example.net/de/81"), (5, None), (6, "no scheme"),
    (7, "http://x.org/es/#top"), (8, "http://org/es/"), (9, "ftp://com/EN/"), (10, "http://notexample.com/en/7"), (11, "http://xcom/en/7"), (12, "://?"), (12, "://?"),
]


def test_url_filters(spark):
    import duckdb

    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("html", F.lit("x")).withColumn("rule", F.lit("mine"))
    got = sorted(map(tuple, urlfilter.op8_url_filters(pages).collect()), key=repr)
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", URLS)
    rel = con.sql(urlfilter.OP8_SQL)
    assert got == sorted(rel.fetchall(), key=repr)
    assert urlfilter.op8_url_filters(pages.limit(0)).collect() == []


def test_cascade_is_exact(spark):
    """A small first filter lets many keys pass; the cascade still decides all."""
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 3)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)] * 2, "key string")
    cascade = urlfilter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    got = {r.key: r.c for r in universe.select("key", cascade.contains(F.col("key")).alias("c")).collect()}
    assert all(c == (int(k[1:]) % 3 == 0) for k, c in got.items())
    assert urlfilter.build_cascade(listed.limit(0), universe).levels == []


def test_nearest_neighbours(spark):
    rng = np.random.RandomState(2)
    v = rng.randn(900, 24)
    v[300:340] = v[20]  # ties
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    data += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0, None] * 12), (None, v[0].tolist()), (2004, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("v", F.lit(1))
    out = {}
    for r in mih.search(df).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(out) == list(range(0, 900, 20))
    hit = 0
    for q, found in out.items():
        found.sort()
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - v[f[1]] @ v[q]) < 1e-9 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & set(want.tolist()))
    assert hit / (20 * len(out)) >= 0.9
    assert [f[1] for f in sorted(out[20])][:20] == list(range(300, 320))
    assert mih.search(df.limit(0)).collect() == []
    few = mih.search(df.filter("vec_id <= 20")).collect()
    assert len(few) == 2 * 20


@pytest.mark.parametrize("bits", [16, 64, 70])
def test_pigeonhole_finds_all(bits):
    """The buckets of all substrings together find every row within the radius, once."""
    rng = np.random.RandomState(bits)
    v = rng.randn(400, bits)
    codes = mih.encode(v, np.eye(bits))
    words = mih.as_words(codes).T
    signs = v >= 0
    for radius in (0, 3, bits // 4, bits // 2, bits):
        found = np.concatenate([mih.Bucket(codes, j).within(codes[7], words[7], radius) for j in range(codes.shape[1])])
        assert sorted(found.tolist()) == np.flatnonzero((signs ^ signs[7]).sum(1) <= radius).tolist()


@pytest.mark.parametrize("n", range(21, 120, 14))
def test_equal_vectors_rank_by_id(n):
    v = np.tile(np.random.RandomState(n).randn(64), (n, 1))
    ids = np.random.RandomState(n).permutation(n)
    found, scores = mih.best_of(ids, v, v[0], 20)
    assert found.tolist() == list(range(20)) and len(set(scores.tolist())) == 1


def test_nearest_in_split_buckets(spark, monkeypatch):
    """Buckets and queries that are dealt over several tasks, many equal vectors, too few within the radius."""
    monkeypatch.setattr(mih, "BASE_BLOCK", 64)
    monkeypatch.setattr(mih, "QUERY_BLOCK", 5)
    rng = np.random.RandomState(4)
    v = rng.randn(600, 40)
    v[100:300] = v[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = {}
    for r in mih.search(df, recall=0.2).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(out) == list(range(0, 600, 20))
    assert all([n for n, _ in sorted(found)] == list(range(1, 21)) for found in out.values())
    assert [d for _, d in sorted(out[100])] == list(range(101, 121))


def test_sample_is_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(mih, "SAMPLE", 1000)
    rows = spark.range(0, 20_000, 1, 8).select("id", F.array(F.lit(1.0)).alias("v"))
    least = rows.select("id", F.xxhash64("id").alias("h")).orderBy("h").limit(1000)
    assert [r["id"] for r in mih.sample_of(rows)] == [r["id"] for r in least.collect()]
    # one id for all rows: whether its hash is small or not, there is a sample
    for one in range(4):
        same = rows.withColumn("id", F.lit(one).cast("long"))
        assert len(mih.sample_of(same)) == 1000
    assert mih.sample_of(rows.limit(0)) == []


def test_long_list_of_urls_is_joined(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    rules = urlfilter.rules_frame(spark)
    by_filter = sorted(map(tuple, urlfilter.judge_urls(pages, rules).collect()), key=repr)
    assert sorted(map(tuple, urlfilter.judge_urls(pages, rules, max_listed=2).collect()), key=repr) == by_filter


def test_long_host_and_path(spark):
    """8 KB of labels make as many keys as the list has shapes."""
    host = ".".join(["a"] * 4000)
    urls = [(1, f"http://{host}.com/en/{'x' * 8000}"), (2, f"http://{host}/en/"), (3, f"http://{'b' * 8000}.net/de/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.op8_url_filters(pages).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "allow"), 3: ("net/de/", "allow")}


def test_long_conversation(spark):
    """Thousands of turns: windows are cut by windows over turns, each turn comes once as new."""
    data = [(1, i, ("system", "user", "assistant")[0 if i == 0 else 1 + i % 2], f"turn {i} " + "w " * (i % 7)) for i in range(6000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    (got,) = chat.read_back(chat.windows(df)).collect()
    assert [(t.i, t.role, t.text, t.loss) for t in got.turns] == [(i, r, x, r == "assistant") for _, i, r, x in data]
    out = chat.windows(df).collect()
    assert len(out) > 50 and all(r.segments[0].i == 0 for r in out)
    assert max(len(r.segments) for r in out) < 250
