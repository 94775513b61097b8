"""The document operators on a small nasty table, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilewright.llm import jaccard, linededup, mixing, quality, sentencepieces, suffixes, tokenfile
from tilewright.llm.queries import tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, key string, h long, size int, kept int"
MODEL, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def passage(seed: int, n: int = 60) -> str:
    rng = np.random.RandomState(seed)
    return " ".join("w" + "".join(map(chr, rng.randint(97, 110, 5))) for _ in range(n))


def texts() -> list[tuple]:
    a, b, c = passage(1, 300), passage(2, 80), passage(3, 120)
    near = a.split(" ")
    near[150] = "changed"
    found = [
        (5, a, "s1"),
        (6, a, "s1"),  # exact copy
        (7, " ".join(near), "s2"),  # near copy
        (8, None, "s1"),
        (9, "", None),
        (10, " \n\t ", None),
        (11, "one two", "s1"),
        (12, "One TWO", "s3"),
        (13, b + "\n" + c, "s2"),
        (14, passage(4) + "\n" + b + "\n" + c + "\nend of it", "é"),
        (15, "same words here " * 40, "s1"),
        (16, "-" * 700, "s2"),
        (17, "naïve café  日本語 😀\x00 x\n\n  spaced ▁ out " + passage(5, 40), "s1"),
        (18, passage(6, 30_000), "big"),  # a very long text
        (None, passage(7, 50), "s1"),
        (20, passage(8, 50), "s1"),
        (20, passage(8, 50), "s1"),  # a repeated row
        (21, "short lines\nshort lines\nmore\nshort lines\nmore", "s3"),
    ]
    return [(d, t, "en", s, len(t or ""), "r", 1, "k", 2, 3, 4) for d, t, s in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(t):
    return WORD.findall(t or "")


def test_empty_tables(spark, empty):
    assert quality.judge(empty).collect() == []
    assert quality.keep_good(empty).columns == empty.columns
    assert linededup.dedup(empty).collect() == []
    assert linededup.remove_line_runs(empty).columns == empty.columns
    assert jaccard.join(empty).collect() == []
    assert mixing.taken(empty).collect() == []
    assert mixing.mix(empty).columns == empty.columns and mixing.mix(empty).count() == 0
    assert sentencepieces.code(empty, tokenizer(MODEL)).collect() == []
    assert tokenfile.op3_token_output(empty, tokenizer(WORDS)).collect() == []
    assert suffixes.remove_repeats(empty).collect() == []


def base_counts(t):
    t = t or ""
    ws = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(docs):
    got = rows(quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == sorted(((r[0], *base_counts(r[1])) for r in texts()), key=repr)


def test_quality_line_frequency(spark):
    """A line over the limit goes everywhere but in its first document; copies of a text count once."""
    common = passage(1, 40)
    data = [(i, common + "\n" + passage(100 + i, 8), "h") for i in range(6)]
    data += [(50 + i, passage(9, 40), "h") for i in range(9)]  # one text nine times
    data += [(90, common.upper() + "  \n" + passage(200, 100), "h"), (91, common, "other")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df, line_limit=4).collect()}
    assert [got[i].kept for i in range(6)] == [True] + [False] * 5
    assert all(got[50 + i].kept for i in range(9))
    assert got[90].kept and got[90].n_removed_words == 40
    assert got[91].kept


def test_quality_lines_leave_the_text(spark):
    """Rows that are kept lose the frequent lines, but in the first document; blank lines stay."""
    common = passage(1, 40)
    text = lambda i: f"{passage(300 + i, 60)}\n\n{common}\n{passage(400 + i, 12)}\n  {common.upper()} \nend"
    data = [(i, text(i), "h") for i in range(6)] + [(90, passage(9, 40), "h"), (91, text(91), "other"), (92, None, "h")]
    # by the limit, less than half of the words may go: one copy here, not two
    data += [(70, f"{passage(500, 100)}\n \n{common.title()}  ", "h"), (71, common, "h")]
    df = spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in data], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in quality.keep_good(df, line_limit=4).collect()}
    want = {d: t for d, t, _ in data if d in (0, 90, 91)} | {70: f"{passage(500, 100)}\n "}
    assert got == {d: (t, len(t)) for d, t in want.items()}


def brute_lines(data, n):
    """(n_lines, n_removed, n_runs, longest_run) of each document, by definition."""
    seqs = {}
    for d, t in data:
        seqs[d] = [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    first = {}
    for d in sorted(seqs):
        for i in range(len(seqs[d])):
            for h in range(1, len(seqs[d]) - i + 1):
                first.setdefault(tuple(seqs[d][i : i + h]), (d, i))
    out = {}
    for d, s in seqs.items():
        gone, runs, longest, covered = set(), 0, 0, 0
        for i in range(len(s)):
            best = max((h for h in range(n, len(s) - i + 1) if first[tuple(s[i : i + h])] < (d, i)), default=0)
            gone |= set(range(i, i + best))
            longest = max(longest, best)
            runs += i + best > covered and best > 0
            covered = max(covered, i + best)
        out[d] = (len(s), len(gone), runs, longest)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_line_dedup(spark, n):
    rng = np.random.RandomState(n)
    data = [(i, "\n".join(rng.choice(["aa", "bb", "cc", "", "  dd "], rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.d: (r.n_lines, r.n_removed, r.n_runs, r.longest_run) for r in linededup.dedup(df, min_lines=n).select("row.doc_id", "*").withColumnRenamed("doc_id", "d").collect()}
    assert got == brute_lines(data, n)


def test_line_dedup_text(docs):
    out = {r.row.doc_id: r for r in linededup.dedup(docs).collect() if r.row.doc_id}
    assert out[8].kept_text is None and out[10].kept_text == " \n\t "
    assert out[14].kept_text == passage(4) + "\nend of it" and out[14].n_runs == 1
    assert out[20].n_removed == 0


def test_runs_copied_from_two_places(spark):
    """A, B and B, C stand apart before A, B, C does: only the last copy is a run of three."""
    data = [(1, "a\nb\nx"), (2, "b\nc\ny"), (3, "a\nb\nc"), (4, "z\na\nb\nc"), (None, "q\nr"), (None, "q\nr"), (5, "q\nr\nq\nr")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r.row.doc_id, r.n_runs, r.longest_run, r.kept_text) for r in linededup.dedup(df).collect()), key=repr)
    want = [(1, 0, 0, "a\nb\nx"), (2, 0, 0, "b\nc\ny"), (3, 2, 2, ""), (4, 1, 3, "z"), (5, 2, 2, ""), (None, 0, 0, "q\nr"), (None, 0, 0, "q\nr")]
    assert got == sorted(want, key=repr)


def test_line_dedup_long_texts(spark):
    text = "\n".join(f"line {i}" for i in range(5000))
    df = spark.createDataFrame([(1, text), (2, "own\n" + text)], "doc_id long, text string")
    got = {r.row.doc_id: (r.kept_text, r.n_removed, r.n_runs, r.longest_run) for r in linededup.dedup(df).collect()}
    assert got == {1: (text, 0, 0, 0), 2: ("own", 5000, 1, 5000)}


def test_long_single_lines(spark):
    """A long line alone goes where it was before, also from texts of one line; short lines stay."""
    long, other, short = passage(31, 50), passage(32, 60), passage(33, 49)
    data = [
        (1, f"head a\n{long}\nfoot a\n{short}"),
        (2, f"head b\n {long} \n\nfoot b\n{short}\nlast"),
        (3, long),
        (4, other),
        (5, f"x\n{other}\ny\n{other}"),
        (6, short),
    ]
    df = spark.createDataFrame([(d, t, len(t)) for d, t in data], "doc_id long, text string, n_chars long").repartition(3)
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.remove_line_runs(df).collect()}
    want = dict(data) | {2: f"head b\n\nfoot b\n{short}\nlast", 5: "x\ny"}
    del want[3]  # nothing is left
    assert got == {d: (t, len(t)) for d, t in want.items()}


def shingles(t, n):
    ws = words((t or "").translate(LOWER))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) or frozenset([tuple(ws)])


def brute_components(data, n, percent):
    sets = {}
    for d, t in data:
        sets.setdefault(d, []).append(shingles(t, n))
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard(spark, docs, n, percent):
    rng = np.random.RandomState(percent)
    base = [passage(s, k).split(" ") for s, k in ((1, 6), (2, 9), (3, 14), (4, 40), (5, 200))]
    data = [(r[0], r[1]) for r in texts() if r[0] is not None]
    for i in range(150):
        w = list(base[i % 5])
        for _ in range(rng.randint(0, 3)):
            w[rng.randint(len(w))] = "x%d" % rng.randint(9)
        data.append((100 + i, " ".join(w[: len(w) - rng.randint(0, 2)])))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(df, shingle=n, percent=percent).collect()}
    assert got == brute_components(data, n, percent)


def test_jaccard_null_id_and_counts(docs):
    out = jaccard.join(docs, shingle=4, percent=85).collect()
    assert len(out) == len(texts())
    assert sorted((r.doc_id, r.n_shingles) for r in out if r.doc_id) == sorted((r[0], len(shingles(r[1], 4))) for r in texts() if r[0])


def test_words_of_structure_stay_apart(spark):
    """Two words of 1,024 letters that any sum of powers modulo 2**64 takes for one."""
    a = ["ab"[bin(i).count("1") % 2] for i in range(1024)]
    one, two = "".join(a), "".join("ab"["ab".index(c) ^ 1] for c in a)
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.class_id) for r in jaccard.join(df).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1)}


def test_long_lists(spark, monkeypatch):
    """Lists that go through blocks and lots, against brute force."""
    monkeypatch.setattr(jaccard, "_SHORT", 4)
    monkeypatch.setattr(jaccard, "_LIST_BLOCK", 16)
    monkeypatch.setattr(jaccard, "_STARS", 1)
    rng = np.random.RandomState(8)
    base = passage(1, 60).split(" ")
    data = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randint(len(w))] = "x%d" % rng.randint(30)
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(df, shingle=2, percent=75).collect()}
    assert got == brute_components(data, 2, 75)


def test_representatives(docs):
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted([5, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, None, 20, 20, 21], key=str)


def test_size_aware_boundary():
    assert jaccard.subset_sizes(7, 12, 85) == [6, 7]
    assert jaccard.boundary({3: 1000, 400: 10}, 50.0, 85) >= 3
    for s in range(1, 60):
        for m in range(s, 60):
            for o in range(s + 1):
                linked = 100 * o >= 85 * (s + m - o)
                assert linked == (o >= jaccard.overlap(s, m, 85))
                if linked:
                    assert s - o < jaccard.prefix(s, 85) and m - o < jaccard.prefix(m, 85)


def brute_targets(sizes, weights):
    """Resharing step by step."""
    ids = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(ids)}
    total, left, out = sum(sizes.values()), set(ids), {}
    while left:
        share = (total - sum(out.values())) / sum(w[s] for s in left)
        over = [s for s in left if share * w[s] > 3 * sizes[s]]
        if not over:
            return out | {s: share * w[s] for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= set(over)
    return out


def test_mixing(docs):
    out = mixing.taken(docs, slots=64).collect()
    assert all((r.first_slot is None) == (r.taken == 0) and (r.first_slot or 0) <= (r.last_slot or 0) for r in out)
    sizes, taken, targets = Counter(), Counter(), {}
    by_id = {(r[0], r[1]): r[3] for r in texts()}
    for r in texts():
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(dict(sizes), (5, 2, 1))
    source_of = {r[0]: r[3] for r in texts()}
    for r in out:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        targets[s] = r.target
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert rows(mixing.taken(docs, slots=64)) == sorted(map(tuple, out), key=repr)
    assert by_id


def test_mix_rows(docs):
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert max(r[0] for r in got.groupBy("doc_id", "text").count().select("count").collect()) <= 6  # a repeated row, three times each


def brute_mix(data, sizes, weights, slots):
    """Document ids in the order of the schedule, point by point."""
    total, goal = sum(sizes.values()), brute_targets(sizes, weights)
    block, ids = -(-total // slots), sorted(sizes)
    starts = {s: {} for s in ids}
    for s in ids:
        at = 0
        mine = sorted((r for r in data if r[2] == s), key=lambda r: hashlib.md5(f"mix{r[0]}".encode()).hexdigest())
        for d, t, _ in mine * 3:
            if at < round(goal[s]):
                starts[s].setdefault(at // block, []).append(d)
            at += len(words(t))
    ends, used, out = np.cumsum([goal[s] for s in ids]) / total, Counter(), []
    for n in range(-(-total // block)):
        x = (n + 0.5) * 0.6180339887498949 % 1
        s = ids[min(int(np.searchsorted(ends, x, "right")), len(ids) - 1)]
        out += starts[s].pop(used[s], [])
        used[s] += 1
    return out, sum(len(d) for b in starts.values() for d in b.values())


def test_mix_order(spark, tmp_path):
    """Rows are written in the order of the schedule; its prefixes stay near the weights."""
    data = [(i, passage(600 + i, 10), "abbccccccc"[i % 10]) for i in range(400)]
    sizes = {s: 10 * sum(r[2] == s for r in data) for s in "abc"}
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    want, late = brute_mix(data, sizes, (5, 2, 1), 800)
    got = [r.doc_id for r in mixing.mix(df, slots=800).collect()]
    assert late <= 3 and got[: len(want)] == want and len(got) == len(want) + late
    mixing.mix(df, slots=800).write.parquet(str(tmp_path / "mix"))
    files = sorted((tmp_path / "mix").glob("part-*"))
    assert [d for f in files for d in pq.read_table(f)["doc_id"].to_pylist()] == got
    goal, count = brute_targets(sizes, (5, 2, 1)), Counter()
    for n, d in enumerate(got, 1):
        count[data[d][2]] += 1
        assert all(abs(count[s] - n * goal[s] / sum(sizes.values())) <= 4 for s in sizes)


def test_sentencepiece_equals_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer(MODEL))
    got = rows(sentencepieces.code(docs, tokenizer(MODEL)))
    want = []
    for r in texts():
        ids = lib.encode(r[1] or "")
        back = lib.decode(ids)
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (r[1] or "")))
    assert got == sorted(want, key=repr)


def test_lattice_streams_and_settles():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer(MODEL))
    model = sentencepieces.codec_of(tokenizer(MODEL)).model
    rng = np.random.RandomState(3)
    for _ in range(60):
        text = "".join(rng.choice(list("abetheinr -\n▁é0"), rng.randint(1, 400)))
        lat, pieces, most = sentencepieces.Lattice(model), [], 0
        for c in model.normalise(text):
            pieces += lat.feed(c)
            most = max(most, len(lat.back))
        pieces += lat.close()
        assert [i for p in pieces for i in model.to_ids(p)] == lib.encode(text)
    long = sentencepieces.Lattice(model)
    seen = 0
    for c in model.normalise(passage(5, 3000)):
        seen += len(list(long.feed(c)))
        assert len(long.back) <= 8 * model.longest
    assert seen > 1000


def test_unigram_viterbi():
    model = sentencepieces.codec_of(tokenizer(MODEL)).model

    class Small:
        unigram, longest, floor = True, 3, -50.0
        scores = {"a": -1.0, "b": -1.0, "ab": -1.5, "ba": -0.6, "aba": -3.0}
        ids = {p: i for i, p in enumerate(scores)}

    lat = sentencepieces.Lattice(Small)
    assert [*lat.feed("ababc"), *lat.close()] == ["a", "ba", "b", "c"]
    assert model.longest > 3


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer(WORDS))
    from tilewright.llm.common import shared_path

    manifest = tokenfile.write_tokens(docs, shared_path(spark, "t"), tokenizer(WORDS))
    got = sorted(map(tuple, tokenfile.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in texts()), key=lambda x: (x is not None, x or 0))
    at = 0
    want = {}
    for r in texts():
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want[r[0]] = (len(ids), zlib.crc32(ids.tobytes()))
    for d, start, n, crc in got:
        assert start == at and want[d] == (n, crc)
        at += n
    shard = tokenfile.Shard(manifest.orderBy("part").first()["path"])
    flat = np.concatenate([x for _, _, x in shard.documents()])
    assert (shard.sequence(0)[: len(flat)] == flat[: tokenfile.SEQUENCE]).all()
    assert sum(shard.sequence(i, "mask").to_pylist().count(True) for i in range(sum(b.num_rows for b in shard.batches))) == len(flat)


def test_letters_and_marks_equal_the_library():
    """Every letter, alone and after another, before a mark: some turn into a letter and a sign that joins it."""
    import pyarrow as pa

    enc = tokenfile.WordEncoder(tokenizer(WORDS))
    letters = [c for c in map(chr, range(0x41, 0x30000)) if c.isalpha()]
    ws = [w for k, c in enumerate(letters) for w in (f"{c}.", f"TEK{c}{'.,;:!?'[k % 6]}")]
    ws += ["don't.", "a.b.", "x…", "12.", "<|endoftext|>", "end<|endoftext|>.", "a1", "", " "]
    ids, n = enc(pa.array(ws))
    cut = np.cumsum([0, *n])
    want = [e.ids for e in enc.tok.encode_batch(ws, add_special_tokens=False)]
    assert [w for w, a, b, i in zip(ws, cut, cut[1:], want) if ids[a:b].tolist() != i] == []


def brute_repeats(data, length):
    first, out = {}, {}
    rows_ = sorted(((-1 if d is None else d), (t or "").encode()) for d, t in data)
    for d, b in rows_:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], (d, i))
    for d, b in rows_:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.setdefault(d, set()).add((len(b), int(gone.sum()), runs, kept))
    return out


@pytest.mark.parametrize("hot", [16_384, 1])
def test_suffix_dedup(docs, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = {}
    for r in suffixes.remove_repeats(docs).collect():
        got.setdefault(-1 if r.doc_id is None else r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert got == brute_repeats([(r[0], r[1]) for r in texts()], 100)


@pytest.mark.parametrize("hot", [16_384, 1])
def test_suffix_dedup_of_shared_ids(spark, hot, monkeypatch):
    """Several texts under one id, and under none: what goes is told by each text."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    p, q, r = (passage(900 + i, 40) for i in range(3))
    data = [(1, p), (30, p + " end"), (30, q), (30, q), (None, r), (None, r + " and " + p), (None, "x" * 300), (31, q[5:] + r), (30, "y " + q), (30, r + r)]
    data += [(40, p[:120] + "1" + q[:130]), (40, p[:120] + "2" + q[:130]), (40, passage(950, 30)), (39, passage(950, 30) + "z")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {}
    for x in suffixes.remove_repeats(df).collect():
        got.setdefault(-1 if x.doc_id is None else x.doc_id, set()).add((x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)))
    assert got == brute_repeats(data, 100)


def test_collection_by_definition():
    rng = np.random.RandomState(5)
    for _ in range(40):
        ss = [bytes(rng.choice([0, 97, 98], rng.randint(0, 12)).astype(np.uint8)) for _ in range(rng.randint(1, 9))]
        data, cut = np.frombuffer(b"".join(ss), np.uint8), np.cumsum([0, *map(len, ss)])
        columns, sizes = suffixes.columns_of(data, cut, 1)
        c = suffixes.Collection(columns, sizes)
        string, length = c.places()
        want = sorted(((s[j:], i) for i, s in enumerate(ss) for j in range(len(s) + 1)), key=lambda t: ([x + 1 for x in t[0]] + [0], t[1]))
        assert [(ss[i][len(ss[i]) - n :], i) for i, n in zip(string, length)] == want
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(want, want[1:])]
        assert c.lcp[1:].tolist() == common


def test_pipeline(spark, sf):
    """run() against its stages by brute force where that is short: every row is a
    kept document whose ids the library gives for the text left after line dedup."""
    import corpus_pipeline
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer(MODEL))
    source = spark.read.parquet(f"{sf}/documents.parquet")
    data = source.collect()
    good = [r for r in data if (c := base_counts(r.text))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    docs = spark.createDataFrame(good, source.schema)
    lines = {r.doc_id: r.text for r in linededup.remove_line_runs(docs).collect()}
    groups = brute_components(list(lines.items()), 5, 80)
    keep = {d: t for d, t in lines.items() if groups[d] == d}
    out = corpus_pipeline.run(spark, sf).collect()
    for r in out:
        assert r.doc_id in keep and r.ids == lib.encode(keep[r.doc_id]) and r.n_pieces == len(r.ids)
    # the mix holds each document as often as its source's stream comes to it
    source_of = {r.doc_id: r.source for r in good}
    want, sizes = Counter(), Counter()
    for d, t in keep.items():
        sizes[source_of[d]] += len(words(t))
    goal = brute_targets(dict(sizes), (5, 2, 1))
    for s in sizes:
        mine = sorted((d for d in keep if source_of[d] == s), key=lambda d: hashlib.md5(f"mix{d}".encode()).hexdigest())
        at = 0
        for d in mine * 3:
            size = len(words(keep[d]))
            want[d] += size > 0 and at < round(goal[s])
            at += size
    assert Counter(r.doc_id for r in out) == +want


def test_tokens_give_memory_back():
    """What an encoding worker holds stays small, however many portions and words it has seen."""
    import subprocess
    import sys

    code = """
import re, sys, threading, time
import numpy as np
import pyarrow as pa
from tilewright.llm import tokenfile

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Rows:
    mapInArrow = staticmethod(lambda f, schema: f)

def batches():
    rng = np.random.default_rng(3)
    for _ in range(5):
        letters = rng.integers(97, 123, (100_000, 7)).astype(np.uint8)
        words = letters.view("S7").ravel().astype(str)
        texts = [" ".join(words[rng.integers(0, len(words), 500)]) for _ in range(2000)]
        yield pa.record_batch([pa.array(np.arange(2000)), pa.array(np.arange(2000)), pa.array(texts)], names=["doc_id", "h", "text"])

made = list(batches())
run = tokenfile._encoded(Rows(), sys.argv[1], [0], 2)
list(run([made[0].slice(0, 1)]))
before, most, n = held(), [0], 0

def watch():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.02)

threading.Thread(target=watch, daemon=True).start()
for b in run(made):
    n += b.num_rows
print(n, most[0] - before)
"""
    out = subprocess.run([sys.executable, "-c", code, tokenizer(WORDS)], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == 10_000 and float(out[1]) < 90, out
