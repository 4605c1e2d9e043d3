"""Each training-data operator on edge cases, and against brute force or SQL over a whole small table."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.llm import bpe, common, components, ctw, decontaminate, licenses, line_dedup, ngram_join, preference, quality, queries, toxicity, url_filter
from evalgrid.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, id long, n long, key string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(lower(t or ""))


def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, 5, 7, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "a b c d e f g h i j k l m n o p q r s t"), (7, "a b c d e f g h i j k l m n o p q r s t"), (None, "no id here at all"), (9, "é à ç  x"), (10, "long " * 30000)]


def test_words_and_shingles_match_plain_python():
    import pyarrow as pa

    given = [t for _, t in EDGE] + ["Ab\x0bcD e\x1cf", "x" * 300, "ß é\n\nA a A a A a"]
    batch = pa.RecordBatch.from_arrays([pa.array(given).slice(0)], ["text"])
    seen = {}
    for part, raw, at in K.blocks(iter([batch]), size=64):
        low = K.LOWER[raw]
        starts, ends, first = K.words(low, at)
        hashes = K.spans_hash(low, starts, ends)
        own, cuts = K.shingles(hashes, first, 4, True)
        for d, t in enumerate(part.column(0).to_pylist()):
            w = [bytes(low[a:b]).decode() for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
            assert w == words(t)
            grams = [tuple(w[i : i + 4]) for i in range(len(w) - 3)] or ([tuple(w)] if w else [])
            for g, h in zip(grams, own[cuts[d] : cuts[d + 1]], strict=True):
                assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def test_stored_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    common.release(spark)
    one, two = (common.stored(spark.range(n), "t") for n in (3, 4))
    assert one.count() == 3 and len(list(tmp_path.iterdir())) == 2
    common.discard(one)
    assert len(list(tmp_path.iterdir())) == 1 and two.count() == 4
    common.release(spark)
    assert not list(tmp_path.iterdir())
    assert common.fits(spark.range(10)) and not common.fits(spark.range(10), 100)


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 199)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 199: 199, 200: 199}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(sets, num, den):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,num,long,block", [(4, 85, 32, 256), (5, 80, 2, 3)])
def test_jaccard_join_equals_all_pairs(spark, data, texts, k, num, long, block):
    near = dict(texts)
    base = max(texts.values(), key=len).split()
    for j in range(40):  # a group of near copies that all differ, and a chain of them
        own = list(base[:120])
        for p in range(j % 7):
            own[(j * 13 + p * 17) % 120] = f"w{j}x{p}"
        near[10_000 + j] = " ".join(own)
        near[20_000 + j] = " ".join(base[200 + 3 * j : 320 + 3 * j])
    got = ngram_join.ngram_jaccard_join(docs(spark, list(near.items())), k=k, num=num, share=0.0, least=6, long=long, block=block).collect()
    sets = {i: shingle_set(t, k) for i, t in near.items()}
    want = brute_components(sets, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in near}
    assert len(set(want.values())) < len(want) - 40


def test_jaccard_join_with_a_key_of_many_different_sets(spark):
    """Ten thousand texts share a passage, so index keys are held by all of them; only the planted pairs link."""
    random = np.random.default_rng(8)
    passage = "one very common passage of ten words that stays the same"
    own = random.integers(0, 10**6, (10_000, 8))
    rows = [(i, f"{passage} " + " ".join(map(str, x))) for i, x in enumerate(own.tolist())]
    rows += [(20_000 + i, f"{rows[i][1]} {passage} {rows[i][1]} more") for i in range(5)] + [(30_000 + i, f"{rows[i][1]} {passage} {rows[i][1]} less") for i in range(5)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs(spark, rows), k=4, num=85, share=0.0, least=1000).collect()}
    assert got == {i: i for i in range(10_000)} | {20_000 + i: 20_000 + i for i in range(5)} | {30_000 + i: 20_000 + i for i in range(5)}


def test_bitmaps_bound_the_difference():
    random = np.random.default_rng(9)
    for n, m, both in ((5, 5, 3), (100, 120, 90), (5000, 4100, 4000), (1, 2, 1)):
        pool = np.unique(random.integers(1, 2**63, n + m, dtype=np.uint64))
        x, y = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        maps = [np.frombuffer(ngram_join.parity(s), np.uint64) for s in (x, y)]
        apart = int(ngram_join.differing(*maps))
        real = n + m - 2 * both
        assert apart <= real and (real < 4 or apart > 0.5 * real), (n, m, both)


def test_jaccard_join_edges(spark):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_jaccard_join(docs(spark, [*EDGE, (7, EDGE[6][1])]), k=4, num=85).collect()}
    assert got == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (6, 17): 6, (7, 17): 6, (None, 2): None, (9, 1): 9, (10, 1): 10}
    assert ngram_join.ngram_jaccard_join(docs(spark, [])).count() == 0
    # An id with several texts links by any of them, also through the copies of one.
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b + " and"), (5, "c d e f g")]
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs(spark, rows), k=4, num=85).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_signatures_of_linked_sets_meet():
    random = np.random.default_rng(3)
    for n in (6, 7, 20, 130, 700):
        for _ in range(20):
            x = np.unique(random.integers(1, 2**62, n, dtype=np.uint64))
            drop = int(len(x) * 0.15 * random.random())
            y = np.unique(np.concatenate([x[drop:], random.integers(1, 2**62, max(0, int(drop * 0.0)), dtype=np.uint64)]))
            if 100 * len(y) < 85 * len(x):
                continue
            common = np.sort(random.choice(x, int(len(x) * random.choice([0, 0.5, 0.95, 1.0])), replace=False))
            rank = random.permutation(len(common))
            a, b = (ngram_join.signatures(s, common, rank, 85, 100)[0] for s in (x, y))
            assert len(x) == len(y) and (x == y).all() or np.isin(a, b).any(), (n, drop, len(common))


def test_line_dedup_edges(spark):
    line = "This line is certainly over forty characters long."
    rows = [(i, f"  {line.upper()}\t\nown {i}\n{line}") for i in range(1, 7)] + [(8, None), (9, ""), (None, line), (10, "a\n\nb\n"), (11, line + "\r"), (12, "short\nshort")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == {**{i: (3, 2, f"own {i}") for i in range(1, 7)}, 8: (1, 0, ""), 9: (1, 0, ""), None: (1, 1, ""), 10: (4, 0, "a\n\nb\n"), 11: (1, 0, line + "\r"), 12: (2, 0, "short\nshort")}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    again = line_dedup.line_dedup(docs(spark, [(1, line)] * 9 + [(2, line)] * 9)).collect()
    assert all(r.n_dropped == 0 for r in again)  # two documents, whatever the number of rows


def test_line_dedup_by_joins_and_on_long_texts(spark, monkeypatch):
    """With nothing broadcast, the same rows; a text of very many lines; rows that share an id but not the text."""
    line = "This line is certainly over forty characters long."
    long = "\n".join([f"x{i}" for i in range(30_000)] + [line])
    rows = [*((i, f"own {i}\n{line}") for i in range(6)), (3, f"{line}\nother"), (4, long), (4, long), (7, line)]
    got = [sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(docs(spark, rows)).collect())]
    monkeypatch.setattr(line_dedup, "by_size", lambda df: df)
    got.append(sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(docs(spark, rows)).collect()))
    want = [*((i, 2, 1, f"own {i}") for i in range(6)), (3, 2, 1, "other"), *[(4, 30_001, 1, long[: -len(line) - 1])] * 2, (7, 1, 0, line)]
    assert got[0] == got[1] == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    df = queries.QUERIES[name](spark, data).select(*names)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(found.fetchall(), key=str)


def test_decontaminate_edges_and_shuffled_form(spark, data, texts):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, f"Before {item.upper()} after"), (2, item.replace("mu", "nu")), (3, " ".join(item.split()[:9])), (4, None), (5, ""), (None, item), (6, "word " * 20000 + item), (6, item)]
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item), (4, "")], "item_id long, text string")
    for limit in (10**6, 0):
        got = sorted(map(tuple, decontaminate.containment_search(docs(spark, rows), items, limit=limit).collect()))
        assert got == [(1, 1, 8, 8), (2, 1, 8, 7), (6, 1, 8, 8)]
    both = [sorted(map(tuple, decontaminate.containment_search(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet"), limit=n).collect())) for n in (10**6, 0)]
    assert both[0] == both[1] and both[0]
    assert decontaminate.containment_search(docs(spark, []), items).count() == 0
    assert decontaminate.containment_search(docs(spark, rows), items.where("false")).count() == 0


def test_decontaminate_tells_rows_apart_and_finds_short_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    other = "one two three four five six seven"
    items = spark.createDataFrame([(1, item, 0), (1, other, 0), (2, "Three  short words", 0), (3, "single", 0)], "item_id long, text string, doc_id int")
    rows = [(1, f"x {item} y"), (1, f"x {other} y"), (2, "these three SHORT words here"), (2, "three words short"), (3, "a\nSingle b"), (4, "singles")]
    for limit in (10**6, 0):
        got = sorted(map(tuple, decontaminate.containment_search(docs(spark, rows), items, limit=limit).collect()))
        assert got == [(1, 1, 3, 3), (1, 1, 8, 8), (2, 2, 1, 1), (3, 3, 1, 1)]


def test_bpe_equals_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_tokenizer())
    odd = ["".join(map(chr, range(a, a + 400))) for a in (1, 0x250, 0x600, 0x1000, 0x1680, 0x2000, 0x3000, 0x1F600)] + ["I'll we've 'S  x\n\n y \t z   ", "a<|endoftext|>b <|endoftext|>", "  x​y", "x" * 5000, " " * 3000, "\x1c\x1d x\x85 y"]
    rows = [*EDGE, *((100 + i, t) for i, t in enumerate(odd)), *((1000 + i, t) for i, t in texts.items())]
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs(spark, rows), keep=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids, (i, (t or "")[:80])
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded == reference.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(docs(spark, [])).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bpe_")]


def test_bpe_over_many_chunks(spark, texts, monkeypatch):
    rows = [*EDGE, *((1000 + i, t) for i, t in texts.items())]
    want = sorted(map(str, bpe.bpe_round_trip(docs(spark, rows)).collect()))
    monkeypatch.setattr(bpe, "CHUNK", 300)
    monkeypatch.setattr(bpe, "GATHER", 50)
    assert sorted(map(str, bpe.bpe_round_trip(docs(spark, rows)).collect())) == want
    assert sorted(map(str, bpe.bpe_round_trip(docs(spark, rows), held=1000).collect())) == want


def test_bpe_decodes_by_join(spark):
    pieces = bpe.piece_table(spark)
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_tokenizer())
    given = ["", "a b", "é à 😀 <|endoftext|> x", "x" * 3000]
    rows = spark.createDataFrame([(i, reference.encode(t, add_special_tokens=False).ids, "z") for i, t in enumerate(given)] + [(9, None, None), (10, [10**6, 64], None)], "n int, ids array<int>, decoded string")
    got = {r.n: bytes(r.decoded).decode() for r in bpe.decode(rows, pieces).collect()}
    assert got == dict(enumerate(given)) | {9: "", 10: bytes(bpe.Vocabulary(open(bpe.default_tokenizer()).read()).pieces[64]).decode()}


def test_base_quality_counts_match_plain_python(spark, data, texts):
    rows = [*EDGE, (20, "a b c d e f a b c d e\nx\n\nx\n y\nx"), (21, "#*$ %&|<> a\na\na \n"), *((1000 + i, t) for i, t in texts.items())]
    labels = spark.read.parquet(f"{data}/labels.parquet").selectExpr("doc_id + 1000 AS doc_id", "quality", "'x' AS id")
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, rows), labels).collect()}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = collections.Counter(windows)
        covered = {j + d for j, x in enumerate(windows) if n[x] > 1 for d in range(5)}
        lines, dup, seen = t.split("\n"), 0, set()
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)), (i, t[:60])
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not r.kept or not r.base_failed) and 0 <= r.score <= 1
    assert quality.quality_rules(docs(spark, []), labels).count() == 0
    assert {r.kept for r in quality.quality_rules(docs(spark, EDGE), labels.where("false")).collect()} <= {True, False}


def test_quality_model_tells_junk():
    random = np.random.default_rng(1)
    import pyarrow as pa

    given, y = [], []
    for i in range(300):
        w = ["".join(random.choice(list("abcdefgh"), 5)) for _ in range(60)]
        y.append(i % 2)
        given.append(" ".join(w) if i % 2 else " ".join(x + random.choice(["###", "$$$", ""]) for x in w))
    batch = pa.RecordBatch.from_arrays([pa.array(given), pa.array(y)], ["text", "quality"])
    (row,) = list(quality._train(iter([batch])))
    shared = type("B", (), {"value": (row.column(0)[0].as_py(), row.column(1)[0].as_py(), row.column(2)[0].as_py())})
    out = next(iter(quality._score(shared)(iter([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(given)], ["id", "text"])]))))
    assert (((out.column(6).to_numpy() >= 0.5).astype(int) == np.array(y)).mean()) > 0.95


def test_quality_score_has_the_ratio_of_all_labels(spark):
    """Texts that tell nothing are scored by the share of good labels, also when the fit takes few rows of each label."""
    random = np.random.default_rng(6)
    rows = [(i, " ".join("".join(random.choice(list("abcdefgh"), 5)) for _ in range(30))) for i in range(1400)]
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i, _ in rows], "id long, quality int")
    frame = spark.createDataFrame(rows, "id long, text string")
    for most in (150, 5000):
        weights, slope, intercept = quality.train(frame, labels, most)
        shared = type("B", (), {"value": (weights, slope, intercept)})
        import pyarrow as pa

        ids, given = zip(*rows)
        out = next(iter(quality._score(shared)(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(given)], ["id", "text"])]))))
        assert 0.78 < out.column(6).to_numpy().mean() < 0.95, most


def test_toxicity_folds_and_learns(spark):
    assert toxicity.fold("ＩＤ1ОТ,  h3y!\n") == " idiot hey "
    assert toxicity.fold(None) == "  " and toxicity.fold("!?") == "  "
    random = np.random.default_rng(5)
    vocabulary = ["".join(random.choice(list("aeiounrst"), 6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = list(random.choice(vocabulary, 50))
        if i % 4 == 0:
            w[7], w[20] = "vilest" if i % 8 else "v1lest", "gromp" + random.choice(["ed", "ing", "er", "est"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, "nothing " * 20 + "VILEST"), (901, "grompish things here"), (902, None), (903, ""), (904, "a trash can here")]
    truth = spark.createDataFrame([*labels, (902, 0), (903, 0), (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), truth.where("doc_id IS NULL OR doc_id < 300 OR doc_id > 800")).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert got[900].predicted == got[901].predicted == 1 and got[902].predicted == got[903].predicted == got[904].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.toxicity(docs(spark, EDGE), truth.where("false")).collect()
    assert len(none) == len(EDGE) and all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(docs(spark, []), truth).count() == 0


def test_exception_phrases_hide_terms():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " scum": 3.0}, ["trash can", "scumbria "])
    assert lexicon.hits(toxicity.fold("a trash can")) == [] and len(lexicon.hits(toxicity.fold("a trash heap, scummy"))) == 2
    assert lexicon.hits(toxicity.fold("Scumbria")) == []


def naive_density(folded, terms, exceptions):
    """Every term at every place of the folded text, but for places inside an exception."""
    safe = [(i, i + len(x)) for x in exceptions for i in range(len(folded)) if folded.startswith(x, i)]
    total = sum(w for t, w in terms.items() for i in range(len(folded)) if folded.startswith(t, i) and not any(a <= i and i + len(t) <= b for a, b in safe))
    return total / (1 + math.log10(folded.count(" "))) if total else 0.0


def test_toxicity_equals_a_naive_scan(spark, data, texts):
    frame = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS id", "text")
    labels = toxicity.training_labels(spark.read.parquet(f"{data}/labels.parquet")).selectExpr("doc_id AS id", "toxic")
    model = toxicity.fit(frame, labels)
    assert model["terms"]
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, data).collect()}
    exceptions = [toxicity.fold(x) for x in model["exceptions"]]
    for i, t in texts.items():
        x = naive_density(toxicity.fold(t), model["terms"], exceptions)
        score = 1 / (1 + math.exp(-(model["slope"] * x + model["intercept"])))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == int(score >= 0.3) and got[i].held_out == held_out(i, 4, 2)
    phrases = {" trash ": 2.0, " scum": 3.0, "can ": 1.0}
    lexicon = toxicity.Lexicon(phrases, ["trash can", "scumbria"])
    for t in ("a trash can and trash", "Scumbria's scum trash can can", "can", "", "trash canned"):
        assert lexicon.density(t) == pytest.approx(naive_density(toxicity.fold(t), phrases, [toxicity.fold(x) for x in ("trash can", "scumbria")]))


def test_toxicity_on_held_out_labels(spark):
    """Over the labelled documents of a table large enough to tell; README has the figures."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.toxicity(rows, toxicity.training_labels(labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    (toxic, caught), (clean, wrong) = (tuple(out.where(f"toxic = {y}").agg(F.count("*"), F.sum("predicted")).first()) for y in (1, 0))
    assert toxic > 100 and caught >= 0.9 * toxic and wrong <= 0.02 * clean


def test_quality_on_held_out_labels(spark):
    """Fitted on the labels of four in five ids, held against those of the fifth: README gives the figures at ten times this size."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality IS NOT NULL")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels.where(rest != 3))
    found = out.where("NOT base_failed").join(labels.where(rest == 3), "doc_id").select("kept", "score", "quality").collect()
    good, bad = [r for r in found if r.quality], [r for r in found if not r.quality]
    assert len(good) > 30 and sum(r.kept for r in good) >= 0.95 * len(good)
    assert sum(r.kept for r in bad) <= 0.34 * max(len(bad), 3)
    assert abs(sum(r.score for r in found) / len(found) - len(good) / len(found)) < 0.1  # calibrated on the whole


def held_out(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_ctw_base_score_and_gain(spark, data, texts):
    got = {r.doc_id: r for r in ctw.op1_ctw(spark, data).collect()}
    train = [words(t) for i, t in texts.items() if not held_out(i, 5, 1)]
    counts = collections.Counter(w for t in train for w in t)
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, t in texts.items():
        w = words(t)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(x in counts for x in w) + 1, n, held_out(i, 5, 1))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len(" ".join(w).encode()) + 1 + bool(w)))


def test_ctw_matches_the_base_on_few_held_out_texts(spark):
    """A thousand documents train both about alike; on ten thousand the trees gain a bit a word (README)."""
    out = [r for r in ctw.op1_ctw(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(out) > 150 and sum(r.score for r in out) > 1.005 * sum(r.base_score for r in out)


def test_ctw_is_a_probability_and_equals_the_recursion():
    import itertools

    random = np.random.default_rng(2)
    old, ctw.DEPTH = ctw.DEPTH, 2
    try:
        sequence = random.choice([97, 98, 99, 32], 400)
        grams = collections.Counter(tuple(sequence[i : i + 3]) for i in range(398))

        def level(d):
            c = collections.Counter()
            for g, n in grams.items():
                c[sum(int(x) << (8 * (d - j)) for j, x in enumerate(g[2 - d :]))] += n
            keys = np.array(sorted(c), np.uint64)
            return keys, np.array([c[int(x)] for x in keys], float)

        tree = ctw.Tree([level(d) for d in range(3)])
        for a, b in itertools.product([97, 99, 120], repeat=2):
            codes = np.array([(a << 16) | (b << 8) | x for x in range(256)], np.uint64)
            assert (2.0 ** tree.log2(codes)).sum() == pytest.approx(1, abs=1e-4)

        def kt(n0, n1):
            return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

        def counts(suffix, j, prefix):
            n = [0, 0]
            for g, c in grams.items():
                if tuple(g[2 - len(suffix) : 2]) == suffix and (int(g[2]) >> (8 - j)) == prefix:
                    n[(int(g[2]) >> (7 - j)) & 1] += c
            return n

        def weighted(suffix, j, prefix):
            n0, n1 = counts(suffix, j, prefix)
            own = kt(n0, n1)
            if len(suffix) == 2:
                return own
            below = sum(weighted((x, *suffix), j, prefix) for x in (32, 97, 98, 99) if sum(counts((x, *suffix), j, prefix)))
            return math.log(0.5) + np.logaddexp(own, below)

        def predict(context, j, prefix, d=0):
            suffix = context[2 - d :]
            n0, n1 = counts(suffix, j, prefix)
            own = (n1 + 0.5) / (n0 + n1 + 1)
            if d == 2:
                return own
            share = math.exp(math.log(0.5) + kt(n0, n1) - weighted(suffix, j, prefix))
            deeper = context[1 - d :]
            child = predict(context, j, prefix, d + 1) if sum(counts(deeper, j, prefix)) else 0.5
            return share * own + (1 - share) * child

        for context, x in (((97, 98), 99), ((32, 97), 97), ((99, 99), 32)):
            want = 0.0
            for j in range(8):
                p = predict(context, j, x >> (8 - j))
                want += math.log2(p if (x >> (7 - j)) & 1 else 1 - p)
            got = tree.log2(np.array([(context[0] << 16) | (context[1] << 8) | x], np.uint64))[0]
            assert got == pytest.approx(want, abs=1e-4)
    finally:
        ctw.DEPTH = old


def test_ctw_edges(spark):
    rows = docs(spark, EDGE)
    got = ctw.ctw_scores(rows, rows.where("doc_id < 8")).collect()
    assert sorted((r.n_tokens for r in got)) == sorted(len(words(t)) + 1 for _, t in EDGE)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    none = ctw.ctw_scores(rows, rows.where("false")).collect()
    assert {r.n_known for r in none} == {0} and [r for r in none if r.doc_id == 4][0].score == pytest.approx(8 * 5 * math.log10(0.5))
    assert ctw.ctw_scores(docs(spark, []), rows).count() == 0


def test_ctw_keeps_every_context(spark, texts, monkeypatch):
    """Scores equal those of one tree of all counts, whatever is broadcast; the tree is held against the recursion above."""
    import pyarrow as pa

    given = dict(sorted(texts.items())[:60])
    learned = {i for i in given if i % 3}
    batch = pa.RecordBatch.from_arrays([pa.array(list(given.values()))], ["text"])
    runs = [codes for _, codes, _, _ in ctw._parts(iter([batch]))]
    cuts = np.cumsum([len(" ".join(words(t)).encode()) + (2 if words(t) else 1) for t in given.values()])
    runs = np.split(np.concatenate(runs), cuts)[:-1]
    train = np.concatenate([r for i, r in zip(given, runs) if i in learned])
    tree = ctw.Tree([ctw._shorter(train, np.ones(len(train)), d) for d in range(ctw.DEPTH + 1)])
    want = {i: float(tree.log2(r).sum() * math.log10(2)) for i, r in zip(given, runs)}
    rows = docs(spark, list(given.items()))
    for head, group in ((1 << 21, 100_000), (50, 300)):
        monkeypatch.setattr(ctw, "HEAD_RUNS", head)
        monkeypatch.setattr(ctw, "GROUP", group)
        got = {r.doc_id: r.score for r in ctw.ctw_scores(rows, rows.where(f"doc_id IN ({','.join(map(str, learned))})")).collect()}
        assert got == pytest.approx(want, rel=1e-5)


def test_ctw_keeps_a_phrase_whatever_the_corpus_size(spark):
    """A phrase seen twice is known by its contexts also when they are a tiny share of the corpus."""
    random = np.random.default_rng(4)

    def score(size):
        noise = bytes(random.choice(np.frombuffer(b"aab ", np.uint8), size)).decode()
        df = docs(spark, [(1, "qzjxvwkqzzyx"), (2, "qzjxvwkqzzyx"), (3, "qzjxvwkqzzyx"), (4, noise)])
        return ctw.ctw_scores(df.where("doc_id = 1"), df.where("doc_id > 1")).first().score

    small, large = score(200_000), score(4_000_000)
    assert large > small - 3


def test_preference_edges(spark):
    shape = "pair_id long, turn long, role string, text string, copy int"
    a = [(1, 0, "user", "q", 9), (1, 1, "assistant", "yes", 9), (2, 0, "user", None, 9), (2, 1, None, "x", 9), (3, 0, "user", "only", 9), (None, 0, "user", "lost", 9), (4, None, "user", "n", 9), (4, 0, "assistant", "z", 9), (4, 0, "assistant", "z", 9), (5, 0, "user", "long " * 50_000, 9)]
    b = [(1, 0, "user", "q", 9), (1, 1, "assistant", "né", 9), (1, 2, "user", "why", 9), (2, 0, "user", None, 9), (2, 1, None, "x", 9), (4, None, "user", "n", 9), (4, 0, "assistant", "z", 9), (5, 0, "user", "long " * 50_000, 9), (6, 0, "assistant", "", 9)]
    out = {r.pair_id: r for r in preference.preference_format(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape)).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6}
    assert (out[1].prompt, out[1].prompt_turns, out[1].chosen, out[1].rejected) == ("<|user|>\nq\n", 1, "<|assistant|>\nyes\n", "<|assistant|>\nné\n<|user|>\nwhy\n")
    assert [tuple(x) for x in out[1].chosen_mask] == [(14, 0), (4, 1)] and [tuple(x) for x in out[1].rejected_mask] == [(14, 0), (3, 1), (9, 0), (4, 0)]
    assert (out[2].prompt, out[2].prompt_turns, out[2].chosen, out[2].chosen_mask) == ("<|user|>\n\n<||>\nx\n", 2, "", [])
    assert (out[3].prompt_turns, out[3].prompt, out[3].chosen, out[3].rejected) == (0, "", "<|user|>\nonly\n", "")
    assert (out[4].prompt_turns, out[4].chosen, out[4].rejected) == (2, "<|assistant|>\nz\n", "")
    assert out[5].prompt_turns == 1 and len(out[5].prompt) == 250_010
    assert [tuple(x) for x in out[6].rejected_mask] == [(14, 0), (1, 1)]
    assert preference.preference_format(spark.createDataFrame([], shape), spark.createDataFrame([], shape)).count() == 0


def test_preference_pairs_share_their_turns_before_the_last_reply(spark, data):
    out = preference.op5_preference_format(spark, data).collect()
    assert len(out) == spark.read.parquet(f"{data}/conversations.parquet").select("conv_id").distinct().count()
    assert sum(r.prompt_turns > 0 for r in out) > 0.7 * len(out) and all("*1" in r.chosen_mask or "<|assistant|>" not in r.chosen for r in out)


def test_url_filter_edges(spark):
    captures = [(1, "http://a.ex.com/x/y", 5), (2, "http://a.ex.com/x/y", 10), (3, "http://b.ex.com/", 10), (4, None, 10), (5, "nonsense", 10), (6, "http://a.ex.com/x/z?q", 700), (7, "http://ex.com", None), (1, "http://a.ex.com/x/y", 5), (8, "HTTP://u@A.EX.com:80/x", 20)]
    entries = [("ex.com", 0, "block"), ("ex.com", 8, "remove"), ("a.ex.com/x", 9, "allow"), ("a.ex.com/x", 9, "block"), ("a.ex.com", 15, "block"), ("a.ex.com/x", 19, "remove"), (None, 1, "block"), ("ex.com", None, "block"), ("ex.com", 600, "odd"), ("ex.com", 650, "block")]
    c, e = spark.createDataFrame(captures, "page_id long, url string, fetched long"), spark.createDataFrame(entries, "key string, at long, action string")
    got = sorted(((r.page_id, r.decision, r.matched, r.valid_from) for r in url_filter.temporal_filter(c, e).collect()), key=str)
    assert got == sorted([(1, "block", "ex.com", 0), (1, "block", "ex.com", 0), (2, "allow", "a.ex.com/x", 9), (3, "none", None, -1), (4, "none", None, -1), (5, "none", None, -1), (6, "block", "a.ex.com", 15), (7, "none", None, -1), (8, "block", "a.ex.com", 15)], key=str)
    assert url_filter.temporal_filter(c.where("false"), e).count() == 0
    assert {r.decision for r in url_filter.temporal_filter(c, e.where("false")).collect()} == {"none"}


def test_url_filter_finds_entries_of_any_depth(spark):
    deep = "a.ex.com/" + "/".join(map(str, range(12)))
    captures = spark.createDataFrame([(1, f"http://{deep}/more", 5), (2, f"http://{deep[:-3]}", 5)], "page_id long, url string, fetched long")
    entries = spark.createDataFrame([(deep, 0, "block"), ("ex.com", 0, "allow")], "key string, at long, action string")
    got = {r.page_id: (r.decision, r.matched) for r in url_filter.temporal_filter(captures, entries).collect()}
    assert got == {1: ("block", deep), 2: ("allow", "ex.com")}


def test_url_filter_is_the_same_in_slices(spark):
    random = np.random.default_rng(11)
    hosts = ["a.ex.com", "b.ex.com", "c.org"]
    captures = [(i, f"http://{hosts[h]}/p/{t % 3}", int(t)) for i, (h, t) in enumerate(zip(random.choice(3, 400, p=[0.8, 0.1, 0.1]), random.integers(0, 10**9, 400)))] + [(900, None, None)]
    entries = [(str(random.choice(["ex.com", "a.ex.com", "a.ex.com/p", "a.ex.com/p/1", "c.org"])), int(random.integers(0, 10**9)), str(random.choice(["block", "allow", "remove"]))) for _ in range(60)]
    c = spark.createDataFrame([(*x, 1) for x in captures], "page_id long, url string, fetched long, key int")
    e = spark.createDataFrame([(*x, "z") for x in entries], "key string, at long, action string, url string")
    got = [sorted(map(str, url_filter.temporal_filter(c, e, n).collect())) for n in (10_000, 7)]
    assert got[0] == got[1] and len(got[0]) == 401
    nulls = c.where("page_id = 900")
    assert [r.decision for r in url_filter.temporal_filter(nulls, e).collect()] == ["none"]


def test_license_edges(spark):
    mit = licenses.known("MIT")
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,")), (2, "Intro.\nReleased  under the MIT LICENCE\nmore"), (3, None), (4, ""), (5, "Copyright 2001 A\n(c) B"), (6, mit + " and more"), (1, mit)]
    got = sorted(((r.doc_id, r.license, r.notices, r.digest is None) for r in licenses.license_scan(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", "", False), (2, None, "MIT", False), (3, None, "", True), (4, None, "", True), (5, None, "", True), (6, None, "", False), (1, "MIT", "", False)], key=str)
    assert licenses.license_scan(docs(spark, [])).count() == 0


def test_license_texts_match_in_any_spelling(spark):
    """Each known text, with each kind of change that the canonical form undoes."""
    changes = [
        str.upper, lambda t: t.replace(" ", "  ").replace(".", " ."), lambda t: "Copyright (c) 1999-2024 The Authors. All rights reserved.\n© 2001 B\n\n" + t, lambda t: t + "\n// Copyright 2020 by C",
        lambda t: t.replace("license", "licence").replace("License", "LICENCE"), lambda t: t.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), lambda t: t.replace("https:", "http:"), lambda t: "\n".join(f" * {x}" for x in t.split("\n")), lambda t: t.replace("\n", "\r\n\r\n"),
    ]
    rows, want = [], {}
    for name, text in licenses.KNOWN:
        for change in changes:
            want[len(rows)] = name
            rows.append((len(rows), change(text)))
    rows.append((10**6, "word " * 100_000 + licenses.known("MIT")))
    got = {r.doc_id: r.license for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert got == want | {10**6: None}


def test_license_list_is_a_parameter(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do this.\nBut not that.")
    (tmp_path / "Other.txt").write_text("Copyright 2020 nobody")
    known = licenses.read_licenses(spark, str(tmp_path))
    got = {r.doc_id: (r.license, r.notices) for r in licenses.license_scan(docs(spark, [(1, "you may do this but NOT that!"), (2, "a\nYou may do this. But not that\nb"), (3, "no")]), known).collect()}
    assert got == {1: ("Own-1.0", "Own-1.0"), 2: (None, "Own-1.0"), 3: (None, "")}
