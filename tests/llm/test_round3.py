"""Merkle manifest, spelling variants and exact dedup: edge cases, and against brute force or SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.llm import ctw, exact_dedup, merkle, quality, queries, spelling, toxicity, url_filter
from evalgrid.llm import textkernel as K

DOCS = "doc_id long, source string, lang string, n_chars long, text string, id long, at long, group string, digest string, word string, n long, d string, norm string, `a b` int"
EXTRA = (5, 7, "g", "d", "w", 1, "x", "y", 3)


def table(spark, rows):
    """(doc_id, lang, text) with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, None if i == 3 else "s", lang, 4, t, *EXTRA) for i, lang, t in rows], DOCS)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests):
    """Root, and for each leaf its path: lists of (run, place)."""
    paths = [[] for _ in digests]
    own = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        for i in range(len(digests)):
            for x in own[i]:
                paths[x].append((digests[i // 8 * 8 : i // 8 * 8 + 8], i % 8))
        own = [sum(own[i : i + 8], []) for i in range(0, len(digests), 8)]
        digests = [H(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
    return digests[0], paths


@pytest.mark.parametrize("n,langs,size", [(1, 1, 4), (9, 1, 4), (70, 3, 5), (150, 70, 7), (600, 2, 16)])
def test_merkle_equals_a_plain_tree(spark, n, langs, size):
    rng = random.Random(n)
    rows = [(i, [None, *"abcdefgé"][k] if (k := i % langs) < 9 else f"z{k}", rng.choice([None, "", "Ab C", "é" * 5, "long " * 2000])) for i in range(n)]
    rows += [(7, "a", "again")] * 2 + [(None, "a", "no id")] if n > 60 else []
    docs = table(spark, rows)
    got = merkle.merkle_manifest(docs, merkle.COLUMNS, carry={"bad": F.sha2(F.lit("x"), 256)}, rows=size)
    got = got.select("*", *[merkle.folded(F.col(c), F.col("places"), F.col("arities"), F.col("siblings")).alias(f"from_{c}") for c in ("leaf", "bad")]).collect()
    trees = {}
    for i, lang, t in rows:
        trees.setdefault(lang, []).append(((i is not None, i), leaf((i, None if i == 3 else "s", lang, 4, t))))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {x: climb([d for _, d in sorted(trees[x])]) for x in order}
    root, top = climb([low[x][0] for x in order])
    want = []
    for at, x in enumerate(order):
        for (key, d), path in zip(sorted(trees[x]), low[x][1], strict=True):
            whole = path + top[at]
            want.append((key[1], x, d, low[x][0], root, [len(r) for r, _ in whole], [p for _, p in whole], [s for r, p in whole for s in r[:p] + r[p + 1 :]]))
    def key(r):
        return str(r)
    assert sorted([(r.doc_id, r.group, r.leaf, r.subroot, r.root, r.arities, r.places, r.siblings) for r in got], key=key) == sorted(want, key=key)
    assert all(r.from_leaf == root and (r.from_bad == root) == (r.leaf == r.bad) for r in got)


def test_merkle_of_no_rows(spark):
    assert merkle.merkle_manifest(table(spark, []).where("false"), merkle.COLUMNS).count() == 0


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("limit,task", [(20_000, 5_000), (3, 10)])
def test_near_words_equal_all_pairs(spark, limit, task):
    rng = random.Random(3)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(6, 9))) for _ in range(300)}
    words |= {"aaaaaa" + "a" * k for k in range(4)} | {"x" * 5000, "x" * 5001, "x" * 4999 + "y", "preface" + "q" * 40}
    vocab = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    n = {r.word: r.n for r in vocab.collect()}
    got = [(r.word, r.near, r.near_n) for r in spelling.near_words(vocab, limit, task).collect()]
    want = [(a, b, n[b]) for a, b in itertools.permutations(words, 2) if near(a, b)]
    assert sorted(got) == sorted(want) and len(want) > 200


def test_forms_and_roots(spark):
    given = {"wordsa": 5, "wordsab": 25, "wordab": 125, "wordac": 125, "wordxab": 624, "lonely": 9, "wordad": 624}
    vocab = spark.createDataFrame(list(given.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(vocab).collect()}
    for w, (form, root, n, n_near, form_n) in got.items():
        close = [x for x in given if x != w and near(x, w)]
        best = min(close, key=lambda x: (-given[x], x), default=None)
        want = best if best and given[best] >= 5 * given[w] else None
        assert (form, n, n_near, form_n) == (want, given[w], len(close), given.get(want))
        while want:
            w, want = want, got[want][0]
        assert root == w
    assert got["wordsa"][1] == "wordxab" and got["lonely"] == (None, "lonely", 9, 0, None)


def test_vocabulary_counts_runs_and_typos(spark):
    text = "Straße STRASSE straße×ÿ naïveté 12 naïveté_Ünder"
    rows = [(i, "x", text) for i in range(300)] + [(None, None, text), (1, "x", None), (2, "x", ""), (3, "x", "z" * 100_000)] + [(5, "x", text)] * 3
    want = {}
    for i, _, t in rows:
        for w in spelling.RUN.findall(t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] = want.get(w, 0) + (len(w) >= 6)
    got = {r.word: r.n for r in spelling.vocabulary(table(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5} and "straße×ÿ" in got
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, "x", "")])).count() == 0


def stripped(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def first_char(text):
    return F.substring(text, 1, 1)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, first_char])
def test_exact_dedup_over_files_that_come_later(spark, tmp_path, digest):
    """A digest that many texts share changes nothing; a second call on the same state reads the new file only."""
    rows = [(1, "x", "a b"), (2, "x", "ab"), (3, "x", "a  b"), (4, "x", None), (5, "x", ""), (6, "x", " \n"), (7, "x", "ac"), (8, "x", "a b"), (9, "x", "abc " * 30_000), (10, "x", "abc" * 30_000)]
    rows += [(None, "x", "a\tb "), (2, "x", "ab"), (None, "x", "only"), (20, "x", "same"), (20, "x", "same"), (30, "x", "Same")] + [(100 + i, "x", "h o t") for i in range(50)]
    path, state = f"{tmp_path}/docs.parquet", f"file://{tmp_path}/state"

    def check(rows):
        got = exact_dedup.exact_dedup(spark, path, checkpoint=state, max_files=1, digest=digest).collect()
        sizes = {}
        for i, _, t in rows:
            sizes.setdefault(stripped(t), []).append((-len(t or ""), i is None, i or 0, i))
        assert len(got) == len(rows)
        for r in got:
            own = sizes[stripped(r.text)]
            assert (r.keep_id, r.group_size, r.text_sha256) == (min(own)[3], len(own), hashlib.sha256(stripped(r.text).encode()).hexdigest())
            assert not r.kept or r.doc_id == r.keep_id
            assert r.digest == "d" and r["a b"] == 3
        assert sum(r.kept for r in got) == len(sizes)

    table(spark, rows[::2]).coalesce(1).write.parquet(path)
    table(spark, rows[1::2]).coalesce(1).write.mode("append").parquet(path)
    check(rows)
    seen = len(list((tmp_path / "state/touched").glob("batch=*")))
    more = [(200, "x", "h  o  t"), (201, "x", "a b      "), (202, "x", "new")]
    table(spark, more).coalesce(1).write.mode("append").parquet(path)
    check(rows + more)
    assert seen == 2 and len(list((tmp_path / "state/touched").glob("batch=*"))) == 3


def test_exact_dedup_of_no_rows(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/docs.parquet")
    assert exact_dedup.exact_dedup(spark, f"{tmp_path}/docs.parquet").count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_variants", "op13_exact_dedup"])
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [x[0] for x in found.description]
    want = sorted(found.fetchall(), key=str)
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert sorted([tuple(r) for r in df.select(columns).collect()], key=str) == want and want


def test_styled_capitals_fold_like_plain_ones():
    bold = "".join(chr(0x1D400 + ord(c) - 65) for c in "TRASH")
    assert toxicity.fold(f"{bold} ＣＡＮ") == toxicity.fold("trash can") == " trash can "


def test_exception_phrases_cover_what_lies_in_them():
    lexicon = toxicity.Lexicon({" tras": 1.0, " clown ": 2.0, "an s": 3.0}, ("trash can", "trash can sale", "clown fish"))
    folded = toxicity.fold("Trash can sale, a clown; clown fish trash " + "trash can " * 5000)
    safe = [(m, m + len(p)) for p in lexicon.exceptions for m in range(len(folded)) if folded.startswith(p, m)]
    want = sorted((m, m + len(t), w) for t, w in lexicon.terms.items() for m in range(len(folded)) if folded.startswith(t, m) and not any(a <= m and m + len(t) <= b for a, b in safe[:50] + [x for x in safe[50:] if abs(x[0] - m) < 40]))
    assert sorted(lexicon.hits(folded)) == want and len(want) == 2


@pytest.mark.parametrize("per_slice", [10_000, 3, 1])
def test_captures_take_the_last_entry_that_has_begun(spark, per_slice):
    rng = random.Random(per_slice)
    keys = ["a.com", "x.a.com", "a.com/p", "a.com/p/q", "b.org"]
    entries = [(rng.choice(keys), rng.randint(0, 60), rng.choice(["block", "allow", "remove", "odd"])) for _ in range(120)] + [(None, 3, "block"), ("a.com", None, "block")]
    captures = [(i, rng.choice(["http://a.com/p/q/r", "https://x.a.com/", "http://b.org", "http://y.x.a.com/p", "http://c.net/", None, "junk"]), rng.choice([None, *range(-2, 63)])) for i in range(300)]
    got = url_filter.temporal_filter(spark.createDataFrame(captures, "page_id long, url string, fetched long"), spark.createDataFrame(entries, "key string, at long, action string"), per_slice).collect()
    weight = {"allow": 3, "block": 2, "remove": 1}

    def active(key, t):
        own = [(at, weight[a], a) for k, at, a in entries if k == key and at is not None and a in weight and at <= t]
        return max(own, default=None)

    names = {"http://a.com/p/q/r": ["a.com/p/q", "a.com/p", "a.com"], "https://x.a.com/": ["x.a.com", "a.com"], "http://b.org": ["b.org"], "http://y.x.a.com/p": ["x.a.com", "a.com"]}
    assert len(got) == 300
    for r in got:
        found = [(len(k), k, e) for k in names.get(r.url, []) if r.fetched is not None and (e := active(k, r.fetched)) and e[2] != "remove"]
        want = max(found, default=None)
        assert (r.decision, r.matched, r.valid_from) == ((want[2][2], want[1], want[2][0]) if want else ("none", None, -1))


def test_quality_scores_equal_a_plain_recursion_over_each_text(spark, data):
    """Every n-gram of every text looked up one by one, in Python integers, with the fitted weights."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    weights, slope, intercept = quality.train(docs.select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), "quality"))
    table_of = np.frombuffer(weights, "<f4").astype(float)
    top, place = (1 << 64) - 1, [int(x) for x in K._PLACE]

    def mix(x):
        return int(K.mix(np.array([x & top], np.uint64))[0])

    def word(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(K.spans_hash(raw, np.array([0]), np.array([len(raw)]))[0])

    def logit(text):
        own = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        kinds = [[mix(h + 1) >> 46 for h in own], [mix(mix(a * place[0] + b * place[1] + 2) + 2) >> 46 for a, b in itertools.pairwise(own)]]
        code = [ord(c) for c in text]
        for k in (3, 4):
            runs = [sum(code[i + j] * place[j] for j in range(k)) for i in range(len(code) - k + 1)]
            kinds.append([((r * 0x9E3779B97F4A7C15 + (k << 60)) & top) >> 46 for r in runs])
        return sum(sum(table_of[p] for p in kind) / max(len(kind), 1) for kind in kinds)

    rows = quality.quality_rules(docs, labels).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(texts) and len({r.kept for r in rows}) == 2
    for r in rows:
        want = 1 / (1 + math.exp(-slope * logit(texts[r.doc_id]) - intercept))
        assert r.score == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= 0.3)


def test_the_base_score_takes_no_trees(spark, data, monkeypatch):
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))
    want = ctw.op1_ctw(spark, data).select(*columns).orderBy("doc_id").collect()

    def refused(*_):
        raise AssertionError("a tree was built")

    monkeypatch.setattr(ctw, "Tree", refused)
    assert ctw.ctw_base(spark, data).orderBy("doc_id").collect() == want and len(want) >= 200


def test_ctw_rows_of_a_task_are_summed_up():
    """Four blocks of a million distinct runs each, the same ones: each run leaves the task once, counted as often as it is
    learned from."""
    import pyarrow as pa

    text = bytes(np.random.default_rng(5).integers(97, 123, 1_000_000, np.uint8)).decode()
    batches = [pa.RecordBatch.from_arrays([pa.array([text]), pa.array([learn])], ["text", "learn"]) for learn in (True, True, False, True)]
    out = pa.Table.from_batches(list(ctw._count(iter(batches)))).to_pandas()
    assert not out.duplicated(["kind", "key"]).any()
    assert set(out.n) <= {3, 6, 9}  # some runs occur twice in the text
    assert out[out.kind == 0].n.sum() == 3 * 1_000_002 and out[out.kind == 1].n.tolist() == [3]


@pytest.mark.parametrize(("raw", "held"), [(1 << 22, 4_000_000), (50, 40), (1, 1)])
def test_ctw_counts_whatever_a_task_holds(monkeypatch, raw, held):
    import collections

    import pyarrow as pa

    monkeypatch.setattr(ctw, "RAW", raw)
    monkeypatch.setattr(ctw, "HELD", held)
    texts = [("to be or not to be", True), (None, True), ("", False), ("to see \n or not", False), ("be", True), ("  ", True), ("to be or not to be", True)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t], pa.string()), pa.array([learn])], ["text", "learn"]) for t, learn in texts]
    got = collections.Counter()
    for batch in ctw._count(iter(batches)):
        for kind, key, n in zip(*(c.to_pylist() for c in batch.columns)):
            got[kind, key] += n
    want = collections.Counter()
    for b in batches:
        for _, runs, words, _ in ctw._parts(iter([b])):
            for kind, keys in ((0, runs), (1, words)):
                for key in keys.view(np.int64).tolist():
                    want[kind, key] += b.column(1)[0].as_py()
    assert dict(got) == dict(want) and 0 in got.values()


@pytest.mark.parametrize("known", [0, 1, 40])
def test_ctw_runs_are_looked_up_by_document(known):
    """More than 256 documents, some without a run, against a dictionary."""
    r = np.random.default_rng(6)
    counts = r.integers(0, 9, 600)
    counts[[0, 255, 256, 599]] = 0
    wanted = r.integers(0, 60, counts.sum()).astype(np.uint64) << np.uint64(49) | np.uint64(7)
    codes = np.unique(wanted)[:known]
    logs = -r.random(len(codes)).astype(np.float32)
    table = dict(zip(codes.tolist(), logs.tolist()))
    totals, rest = ctw._runs_looked_up(codes, logs, wanted, counts)
    for total, left, own in zip(totals, rest.to_pylist(), np.split(wanted, np.cumsum(counts)[:-1]), strict=True):
        assert total == pytest.approx(sum(table.get(x, 0.0) for x in own.tolist()))
        assert sorted(left) == sorted(x for x in own.view(np.int64).tolist() if x not in table)
