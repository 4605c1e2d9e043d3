"""Golden values, refusals, and agreement of the two tiers, of splits, and of racing with plain scoring."""

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.__main__ import main as cli
from evalgrid.functions import penalties as P
from evalgrid.functions.losses import COSTS, loss, loss_array
from evalgrid.functions.squash import SQUASHES, UnsupportedSquash, limited, limited_array, squash_of
from evalgrid.operators import sampling
from evalgrid.operators.scoring import components, partials, result_json, score_bin, score_population
from evalgrid.plans.arrow_tier import Kernel
from evalgrid.plans.creature import Creature, CreatureError, Neuron, Synapse, compile_creature, compiled, emit_creature, parse_creature, validate
from evalgrid.queries import FAULTY, NETWORKS, POPULATION
from evalgrid.sources import corpus as C
from evalgrid.sources import creatures as K
from evalgrid.streaming import racing

IDENTITY = K.linear([1.0])


def corpus(spark, x, t, parts=3):
    x, t = np.asarray(x, float).reshape(len(x), -1).tolist(), np.asarray(t, float).reshape(len(t), -1).tolist()
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, t))], "record_idx long, features array<float>, targets array<float>").repartition(parts)


def test_activations_agree_in_both_forms(spark):
    x = np.array([-800, -40, -2.5, -1e-11, -0.3, 0.0, 0.3, 1.0, 2.5, 36.5, 40, 800], np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x float")
    for name, s in SQUASHES.items():
        got = np.array([r.y for r in df.select("i", limited(s, F.col("x")).alias("y")).orderBy("i").collect()], np.float32)
        want = limited_array(s, x)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=2e-6, atol=1e-30), name
        assert got.min() >= np.float32(s.low) and got.max() <= np.float32(s.high), name
    assert [s.code for s in SQUASHES.values()] == list(range(32))


def test_names_are_exact_and_unpublished_ones_refused():
    assert squash_of(None).name == "IDENTITY"
    for name in ("HYPOT", "HYPOTv2", "MEAN", "tanh", "Relu"):
        with pytest.raises(UnsupportedSquash):
            squash_of(name)


def test_losses_agree_in_both_forms(spark):
    random = np.random.default_rng(0)
    t, o = random.uniform(0, 1, (9, 3)), random.uniform(0, 1, (9, 3))
    t[0], o[0] = [1, 0, 0], [1e-20, 1, 0.5]
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(t, o))], "i int, t0 double, t1 double, t2 double, o0 double, o1 double, o2 double")
    for cost in COSTS:
        got = [r.v for r in df.select("i", loss(cost, [F.col(f"t{j}") for j in range(3)], [F.col(f"o{j}") for j in range(3)]).alias("v")).orderBy("i").collect()]
        assert got == pytest.approx(list(loss_array(cost, t.T, o.T)), rel=1e-12)


def test_categorical_counts_misses_and_ties_take_the_first(spark):
    c = Creature(2, 2, (Neuron("output", "output-0", 0.0), Neuron("output", "output-1", 0.0)), (Synapse("input-0", "output-0", 1.0), Synapse("input-1", "output-1", 1.0)))
    df = corpus(spark, [[1, 0], [0, 1], [0.5, 0.5], [0.5, 0.5]], [[1, 0], [1, 0], [1, 0], [0, 1]])
    for tier in ("sql", "arrow"):
        (r,) = partials(df, {"c": c}, "CATEGORICAL_ERROR", tier).collect()
        assert (r.loss_sum, r.n) == (2.0, 4)


def test_penalty_curve():
    assert P.value_penalty(0.5) == P.value_penalty(1.0) == 0
    assert P.value_penalty(10.0) == pytest.approx(0.999 / 12)
    assert P.value_penalty(1e12) == pytest.approx(0.999) and P.value_penalty(1e13) == pytest.approx(0.999 + 0.001 / 13)
    assert P.magnitude_penalty(-1e195) == P.magnitude_penalty(9007199254740991.0) < 1
    for bad in (-1.0, math.inf):
        with pytest.raises(ValueError):
            P.value_penalty(bad)
    with pytest.raises(ValueError):
        P.magnitude_penalty(math.nan)


def test_components(spark):
    c = Creature(1, 1, (Neuron("constant", "one", 100.0), Neuron("hidden", "h", 0.0, "IF"), Neuron("output", "output-0", -0.5, "ODD")), (Synapse("input-0", "h", -1e6, "condition"), Synapse("h", "output-0", 0.5)))
    (r,) = components(K.creature_table(spark, {"c": c})).collect()
    assert (r.hidden_neurons, r.synapse_count, r.squash_penalty, r.max_weight_bias) == (2, 2, 3.0, 1e6)
    assert r.avg_weight_bias == pytest.approx((100 + 0 + 0.5 + 1e6 + 0.5) / 5)
    assert r.mean_value_penalty == pytest.approx((P.value_penalty(100) + P.value_penalty(1e6)) / 5)


def test_identity_scores_and_versions(spark):
    df = corpus(spark, [1, 2, 3, 4], [1, 2, 3, 4])
    (r,) = score_population(df, {"c": IDENTITY}).collect()
    assert (r.error, r.record_count, r.hidden_neurons, r.synapse_count) == (0, 4, 0, 1) and r.score == pytest.approx(1 - 1e-8, abs=1e-12)
    old = Creature(1, 1, IDENTITY.neurons, IDENTITY.synapses, semantic_version="3.9")
    (r,) = score_population(df, {"c": old}).collect()
    assert r.score == pytest.approx(1 - 1e-8 - 1e-6, abs=1e-12)


def test_negative_mean_and_no_records_are_errors(spark):
    with pytest.raises(Exception, match="cannot be scored"):
        score_population(corpus(spark, [1, 1], [0.5, 0.5]), {"c": IDENTITY}, "MSLE").collect()
    with pytest.raises(Exception, match="no records"):
        score_population(corpus(spark, [1], [1]).where("false"), {"c": IDENTITY}, tier="sql").collect()


def test_recurrent_edges_carry_zero(spark):
    x = [0.25, 0.5, -0.25, 0.75, -0.5, 1.0, -0.75, 0.125]
    loop = Creature(1, 1, (Neuron("hidden", "h", 0.0, "IDENTITY"), Neuron("output", "output-0", 0.0, "IDENTITY")), (Synapse("input-0", "h", 0.5), Synapse("h", "output-0", 1.0), Synapse("output-0", "h", 0.5)), forward_only=False)
    for tier in ("sql", "arrow"):
        (r,) = partials(corpus(spark, x, [0] * 8), {"c": loop}, "MSE", tier).collect()
        assert r.loss_sum == sum((v / 2) ** 2 for v in x)
    with pytest.raises(CreatureError, match="cycle"):
        compile_creature(Creature(1, 1, loop.neurons, loop.synapses))


def test_if_boundary_goes_negative():
    net = Kernel(compile_creature(NETWORKS["agg_if_boundary"]))
    half = np.float32(0.5)
    x = np.array([[v, 0, 0] for v in (np.nextafter(half, np.float32(0)), half, np.nextafter(half, np.float32(1)), np.nan)], np.float32)
    assert net.run(x)[:, 0].tolist() == [-1, -1, 1, -1]


def test_aggregates_without_inputs_give_the_bias():
    for kind in ("MINIMUM", "MAXIMUM"):
        c = Creature(1, 1, (Neuron("output", "output-0", 0.75, kind),), ())
        assert Kernel(compile_creature(c)).run(np.zeros((2, 1), np.float32)).ravel().tolist() == [0.75, 0.75]


def test_tiers_agree_and_compile_once(spark):
    random = np.random.default_rng(4)
    df = corpus(spark, random.uniform(-1, 1, (200, 3)), random.uniform(0, 1, 200))
    for name, c in (NETWORKS | POPULATION).items():
        a, b = (partials(df, {"c": c}, "MSE", tier).first() for tier in ("sql", "arrow"))
        assert a.n == b.n == 200 and a.loss_sum == pytest.approx(b.loss_sum, rel=1e-5), name
    before = compiled["calls"]
    out = score_population(df, POPULATION, tier="arrow")
    assert compiled["calls"] - before == len(POPULATION)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 2
    single = {k: score_population(df, {k: c}, tier="arrow").first() for k, c in POPULATION.items()}
    for r in out.collect():
        assert r.error == pytest.approx(single[r.key].error, rel=1e-9) and r.record_count == 200


def test_sampling_goldens(spark):
    keep = [i for i in range(8) if spark.range(1).select(sampling.kept(F.lit(i), 0.5)).first()[0]]
    assert keep == [1, 3, 5, 7]
    df = corpus(spark, range(8), [0] * 8)
    for parts in (1, 5):
        (r,) = score_population(df.repartition(parts), {"c": IDENTITY}, sample_rate=0.5).collect()
        assert (r.error, r.record_count, r.sample_rate) == (21.0, 4, 0.5)
    (r,) = score_population(df, {"c": IDENTITY}, sample_phase=3).collect()
    assert (r.error, r.record_count, r.sample_rate) == (17.5, 8, None)
    for bad in (0.0, -1.0, 1.5, math.nan, math.inf):
        with pytest.raises(ValueError, match="sample rate"):
            sampling.sample(df, bad)


def test_refusals_name_the_fault():
    def fails(match, **change):
        with pytest.raises(CreatureError, match=match):
            validate(Creature(**({"input": 1, "output": 1, "neurons": IDENTITY.neurons, "synapses": IDENTITY.synapses} | change)))

    fails("input 0", input=0)
    fails("output 0", output=0)
    fails("nowhere is not a listed", synapses=(Synapse("input-0", "nowhere", 1.0),))
    fails("input-0 is not a listed", synapses=(Synapse("input-0", "input-0", 1.0),))
    fails("neither an input", synapses=(Synapse("input-7", "output-0", 1.0),))
    fails("non-finite weight", synapses=(Synapse("input-0", "output-0", math.inf),))
    fails("non-finite bias", neurons=(Neuron("output", "output-0", math.nan),))
    fails("duplicate synapse", synapses=IDENTITY.synapses * 2)
    fails("duplicate typed", synapses=(*IDENTITY.synapses, Synapse("input-0", "output-0", 1.0, "positive")))
    validate(NETWORKS["fwd_dual_role"])
    with pytest.raises(CreatureError, match="limit"):
        validate(IDENTITY, max_nodes=1)
    validate(IDENTITY, max_nodes=2)
    with pytest.raises(CreatureError, match="narrow"):
        K.check_shape({"good": FAULTY["good"], "narrow": FAULTY["narrow"]})
    with pytest.raises(ValueError, match="unknown cost"):
        partials(None, {"c": IDENTITY}, "mse")


def test_json_and_memetic_forms():
    text = emit_creature(NETWORKS["agg_if"])
    assert parse_creature(text) == NETWORKS["agg_if"]
    data = json.loads(text)
    for weights in ([{"fromUUID": "a", "toUUID": "b", "weight": 1.0}], [], {"a": [{"toUUID": "b", "weight": 1.0}]}):
        assert parse_creature(json.dumps(data | {"memetic": {"generation": 1, "weights": weights}})) == NETWORKS["agg_if"]
    for bad, field in (({"memetic": {"weights": 5}}, "memetic.weights"), ({"input": "x"}, "input"), ({"neurons": 1}, "neurons"), ({"forwardOnly": 1}, "forwardOnly")):
        with pytest.raises(CreatureError, match=field):
            parse_creature(json.dumps(data | bad))
    with pytest.raises(CreatureError, match="bias"):
        parse_creature(json.dumps(data | {"neurons": [{"type": "hidden", "uuid": "h"}]}))
    with pytest.raises(CreatureError, match="not JSON"):
        parse_creature("{")


def test_binary_corpus(spark, tmp_path):
    values = np.arange(60, dtype="<f4").reshape(20, 3)
    for name, rows in (("2.bin", values[:7]), ("10.bin", values[7:]), ("11.bin", values[:0])):
        rows.tofile(tmp_path / name)
    rows = C.read_bin(spark, str(tmp_path), 2, 1, split=36).orderBy("record_idx").collect()
    assert [r.record_idx for r in rows] == list(range(20)) and [[*r.features, *r.targets] for r in rows] == values.tolist()
    assert [r.file_idx for r in rows] == [0] * 7 + [1] * 13
    total = C.float_scan(C.read_bin(spark, str(tmp_path), 2, 1)).first()
    assert (total.total, total.n_values) == (values.sum(), 60)
    C.write_bin(C.read_bin(spark, str(tmp_path), 2, 1), str(tmp_path / "again"), 3)
    again = C.read_bin(spark, str(tmp_path / "again"), 2, 1).orderBy("record_idx").collect()
    assert [[*r.features, *r.targets] for r in again] == values.tolist()
    np.zeros(4, "<f4").tofile(tmp_path / "3.bin")
    with pytest.raises(C.CorpusError, match=r"3\.bin has 16 bytes, 4 over .* 0 other"):
        C.read_bin(spark, str(tmp_path), 2, 1)
    for path, match in ((tmp_path / "3.bin", "not a folder"), (tmp_path / "none", "not a folder")):
        with pytest.raises(C.CorpusError, match=match):
            C.read_bin(spark, str(path), 2, 1)
    (tmp_path / "empty").mkdir()
    with pytest.raises(C.CorpusError, match="no .bin files"):
        C.read_bin(spark, str(tmp_path / "empty"), 2, 1)
    (tmp_path / "empty" / "1.bin").touch()
    with pytest.raises(C.CorpusError, match="no records"):
        C.read_bin(spark, str(tmp_path / "empty"), 2, 1)


def test_folder_of_creatures_scores_binary_corpus(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "d").mkdir()
    population = {"b": K.linear([0.5]), "a": IDENTITY}
    K.write_creatures(population, lambda name, text: (tmp_path / "c" / name).write_text(text))
    np.array([[1, 1], [2, 2]], "<f4").tofile(tmp_path / "d" / "1.bin")
    read = K.read_creatures(spark, str(tmp_path / "c"))
    assert list(read) == ["a", "b"] and read == population
    out = json.loads(result_json(score_bin(spark, read, str(tmp_path / "d"))))
    assert list(out) == ["a", "b"] and out["a"]["error"] == 0 and out["b"]["error"] == 0.625 and out["a"]["recordCount"] == 2 and "sampleRate" not in out["a"]
    one = json.loads(result_json(score_bin(spark, emit_creature(IDENTITY), str(tmp_path / "d")), keyed=False))
    assert one["score"] == out["a"]["score"] and one["costName"] == "MSE"
    with pytest.raises(ValueError, match="empty"):
        score_bin(spark, " ", str(tmp_path / "d"))


def linear_race(spark, n=60):
    r = np.arange(n)
    x = np.stack([np.sin(0.01 * r), np.cos(0.017 * r)], 1)
    return corpus(spark, x, 0.4 * x[:, 0] + 0.5 * x[:, 1]), {f"c{i}": K.linear([0.3 + 0.15 * i, 0.5]) for i in range(3)}


def test_race_continue_equals_plain_and_aborted_ones_freeze(spark):
    df, population = linear_race(spark)
    plain = {r.key: r for r in score_population(df, population).collect()}
    calls = []
    out = {r.key: r for r in racing.race(df, population, lambda rows: calls.append(rows) or racing.CONTINUE, 20).collect()}
    assert len(calls) == 3 and all(out[k].error == pytest.approx(plain[k].error, rel=1e-12) and out[k].record_count == 60 for k in population)
    frozen = {r.key: r for r in racing.race(df, population, lambda rows: {2, 99} if rows[0].records_scored == 20 else set(), 20).collect()}
    assert frozen["c2"].record_count == 20 and frozen["c2"].error == pytest.approx(calls[0][2].partial_error)
    assert frozen["c0"].error == pytest.approx(plain["c0"].error, rel=1e-12)
    stopped = racing.race(df, population, lambda rows: racing.ABORT_ALL, 20).collect()
    assert {r.record_count for r in stopped} == {20}
    rmse = []
    racing.race(df, population, lambda rows: rmse.append(rows[0].partial_error) or set(), 60, cost="RMSE")
    assert rmse[0] == pytest.approx(plain["c0"].error)  # partials take no root


def test_race_chunks_count_kept_records(spark):
    df, population = linear_race(spark)
    seen = []
    racing.race(df, population, lambda rows: seen.append(rows[0].records_scored) or set(), 10, sample_rate=0.4, sample_phase=1)
    n = score_population(df, population, sample_rate=0.4, sample_phase=1).first().record_count
    assert seen == [10, 20, n] and n == 24


def test_stdio_referee():
    lines, out = iter(['{"verdict":"continue"}', '{"verdict":"abort","creatures":[1]}', '{"verdict":"abortAll"}']), []
    referee = racing.StdioReferee(lambda: next(lines), out.append)
    rows = [racing.Partial(0, "a", 0.5, 10)]
    assert referee(rows) == racing.CONTINUE and referee(rows) == {1} and referee(rows) is racing.ABORT_ALL
    assert json.loads(out[0])["chunk"] == 1
    assert json.loads(out[1]) == {"racing": "chunk", "chunk": 2, "partials": [{"index": 0, "key": "a", "partialError": 0.5, "recordsScored": 10}]}
    for bad in ("", "\n", "{", '{"verdict":"maybe"}', '{"verdict":"abort"}', '{"verdict":"abort","creatures":["x"]}', "[]"):
        with pytest.raises(racing.RacingError):
            racing.StdioReferee(lambda bad=bad: bad, out.append)(rows)


def test_stream_sums_equal_batch(spark, tmp_path):
    df, population = linear_race(spark)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    racing.stream_partials(stream, population, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    sums = {r.key: r for r in spark.read.parquet(str(tmp_path / "out")).groupBy("key").agg(F.sum("loss_sum").alias("s"), F.sum("n").alias("n")).collect()}
    for r in score_population(df, population, tier="arrow").collect():
        assert sums[r.key].n == 60 and sums[r.key].s / 60 == pytest.approx(r.error, rel=1e-9)


@pytest.mark.parametrize("tier", ["sql", "arrow"])
def test_malformed_records_are_refused_by_both_tiers(spark, tier):
    shape = "record_idx long, features array<float>, targets array<float>"
    for x, t in (([None, 2.0], [1.0]), ([1.0, 2.0, 9.0], [1.0]), ([1.0], [1.0]), (None, [1.0]), ([1.0, 2.0], [None]), ([1.0, 2.0], []), ([1.0, 2.0], [1.0, 2.0])):
        with pytest.raises(Exception, match="corpus records must have"):
            partials(spark.createDataFrame([(0, x, t)], shape), {"c": K.linear([0.5, 0.5])}, "MSE", tier).collect()


def test_index_over_groups_of_buckets(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 5000 AS v")
    out = C.with_index(rows, F.floor(F.col("v") / 10), "v", group=3).orderBy("v").collect()
    assert [r.record_idx for r in out] == list(range(1000))


def test_bounds_become_byte_ranges(spark, tmp_path):
    values = np.arange(3000, dtype="<f4").reshape(1000, 3)
    values[:400].tofile(tmp_path / "1.bin")
    values[400:].tofile(tmp_path / "2.bin")
    read = 0
    for first, last in racing.chunk_bounds(C.record_count(str(tmp_path), 2, 1), 50, 1.0, 0):
        reader = C._Reader({"path": str(tmp_path), "inputs": "2", "outputs": "1"})
        assert list(reader.pushFilters([C.GreaterThanOrEqual(("record_idx",), first), C.LessThanOrEqual(("record_idx",), last)])) == []
        read += sum(p.records for p in reader.partitions())
    assert read == 1000  # twenty chunks read the corpus once
    df = C.read_bin(spark, str(tmp_path), 2, 1, split=240)
    assert sorted(r.record_idx for r in df.where("record_idx > 390 AND record_idx <= 410").collect()) == list(range(391, 411))
    assert df.where("record_idx > 5000").count() == 0 and df.where("record_idx < 7 AND features[0] > 3").count() == 5
    with pytest.raises(C.CorpusError, match="not empty"):
        C.write_bin(df, str(tmp_path), 2)
    uneven = spark.createDataFrame([(0, [1.0], [1.0]), (1, [1.0, 2.0], [1.0])], "record_idx long, features array<float>, targets array<float>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        C.write_bin(uneven, str(tmp_path / "uneven"), 1)


def test_files_of_a_written_corpus_are_bounded(spark, tmp_path):
    random = np.random.default_rng(13)
    df = corpus(spark, random.uniform(-1, 1, (3000, 3)), random.uniform(0, 1, 3000))
    C.write_bin(df, str(tmp_path / "c"), 2, file_bytes=16 * 200)
    sizes = [n for _, n, _ in C.bin_files(str(tmp_path / "c"), 16)]
    assert len(sizes) == 15 and sum(sizes) == 3000 and max(sizes) < 600
    columns = ("record_idx", "features", "targets")
    assert C.read_bin(spark, str(tmp_path / "c"), 3, 1).orderBy("record_idx").select(*columns).collect() == df.orderBy("record_idx").select(*columns).collect()


def test_scan_of_bytes_equals_both_tiers(spark, tmp_path):
    random = np.random.default_rng(12)
    df = corpus(spark, random.uniform(-1, 1, (500, 3)), random.uniform(0, 1, 500))
    C.write_bin(df, str(tmp_path / "c"), 3)
    for rate, phase in ((1.0, 0), (0.3, 2)):
        want = {r.key: r for r in score_population(df, POPULATION, sample_rate=rate, sample_phase=phase, tier="sql").collect()}
        for tier in ("auto", "sql"):
            got = score_bin(spark, POPULATION, str(tmp_path / "c"), sample_rate=rate, sample_phase=phase, tier=tier).collect()
            assert {r.key for r in got} == set(want)
            assert all(r.error == pytest.approx(want[r.key].error, rel=1e-5) and r.record_count == want[r.key].record_count for r in got)


@pytest.fixture
def folders(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "d").mkdir()
    K.write_creatures({"b": K.linear([0.5]), "a": IDENTITY}, lambda name, text: (tmp_path / "c" / name).write_text(text))
    np.array([[1, 1], [2, 2], [3, 3], [4, 4]], "<f4").tofile(tmp_path / "d" / "1.bin")
    return str(tmp_path / "c"), str(tmp_path / "d")


def test_command_line_scores_folders_files_and_stdin(spark, folders, capsys, monkeypatch):
    creatures, records = folders
    monkeypatch.setattr("pyspark.sql.SparkSession.Builder.getOrCreate", lambda self: spark)
    assert cli([creatures, records]) == 0
    out = json.loads(capsys.readouterr().out)
    assert list(out) == ["a", "b"] and out["a"]["error"] == 0 and out["b"]["error"] == 1.875 and out["b"]["recordCount"] == 4
    assert cli([f"{creatures}/b.json", records, "--cost", "MAE", "--sample-rate", "0.5"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["error"], out["recordCount"], out["costName"], out["sampleRate"]) == (1.5, 2, "MAE", 0.5)
    monkeypatch.setattr("sys.stdin", io.StringIO(emit_creature(IDENTITY)))
    assert cli(["--creature-stdin", records]) == 0 and json.loads(capsys.readouterr().out)["error"] == 0


def test_command_line_races_by_lines(spark, folders, capsys, monkeypatch):
    creatures, records = folders
    monkeypatch.setattr("pyspark.sql.SparkSession.Builder.getOrCreate", lambda self: spark)
    monkeypatch.setattr("sys.stdin", io.StringIO('{"verdict":"abort","creatures":[1]}\n{"verdict":"continue"}\n'))
    assert cli([creatures, records, "--race-stdio", "2"]) == 0
    first, second, result = capsys.readouterr().out.split("\n", 2)
    assert json.loads(first) == {"racing": "chunk", "chunk": 1, "partials": [{"index": 0, "key": "a", "partialError": 0.0, "recordsScored": 2}, {"index": 1, "key": "b", "partialError": 0.625, "recordsScored": 2}]}
    assert [r["index"] for r in json.loads(second)["partials"]] == [0] and json.loads(second)["chunk"] == 2
    assert {k: v["recordCount"] for k, v in json.loads(result).items()} == {"a": 4, "b": 2}
    monkeypatch.setattr("sys.stdin", io.StringIO(""))
    assert cli([creatures, records, "--race-stdio", "2"]) == 1 and "ended" in capsys.readouterr().err


def test_command_line_refuses(spark, folders, capsys, monkeypatch):
    creatures, records = folders
    monkeypatch.setattr("pyspark.sql.SparkSession.Builder.getOrCreate", lambda self: spark)
    for args in ([creatures], [creatures, records, "--cost", "mse"], [creatures, records, "--sample-rate", "0"], [creatures, records, "--sample-phase", "-1"], [creatures, f"{records}/1.bin"], [f"{creatures}/a.json", records, "--race-stdio", "2"], [f"{creatures}/none.json", records]):
        assert cli(args) == 1 and capsys.readouterr().err.startswith("error: "), args


def test_only_the_entry_names_the_training_package():
    import pathlib

    root = pathlib.Path(C.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
