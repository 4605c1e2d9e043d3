"""Populations as tables, ranks by ranges, sampled byte spans, streams of packed records, races in one query."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.operators import graph, ranking, validation
from evalgrid.operators.scoring import partials, score_population, score_table, totals
from evalgrid.plans import arrow_tier, population
from evalgrid.plans.creature import Creature, CreatureError, Neuron, Synapse, compile_creature
from evalgrid.plans.population import creature_of
from evalgrid.queries import FAULTY, NETWORKS, POPULATION, RACERS
from evalgrid.sources import corpus as C
from evalgrid.sources import creatures as K
from evalgrid.sources import derived
from evalgrid.streaming import racing

from .test_exact import uneven
from .test_scorer import corpus


def held(table):
    return {r.key: creature_of(r.asDict(recursive=True)) for r in table.collect()}


def test_levels_and_sources_equal_the_compiled_ones(spark, data):
    named = NETWORKS | {f"u{i}": uneven(i) for i in range(5)}
    table = K.creature_table(spark, named).unionByName(derived.supplier_population(spark, data))
    got = {(r.key, r.node): r.level for r in graph.levels(table).collect()}
    want = {(k, s.node): s.level for k, c in held(table).items() for s in compile_creature(c).steps}
    assert got == want and len(got) > 60
    ends = {}
    for r in graph.resolved(table).collect():
        ends.setdefault((r.key, r.target), []).append(r.source)
    for k, c in held(table).items():
        place = {n.uuid: c.input + i for i, n in enumerate(c.neurons)} | {f"input-{i}": i for i in range(c.input)}
        for n in c.neurons:
            own = sorted(place[s.source] for s in c.synapses if s.target == n.uuid)
            assert sorted(ends.get((k, place[n.uuid]), [])) == own


def test_cycles_and_unknown_ends(spark):
    loop = Creature(1, 1, (Neuron("hidden", "h", 0.0), Neuron("output", "output-0", 0.0)), (Synapse("input-0", "h", 1.0), Synapse("h", "output-0", 1.0), Synapse("output-0", "h", 1.0)))
    with pytest.raises(CreatureError, match="cycle"):
        graph.levels(K.creature_table(spark, {"loop": loop})).collect()
    odd = Creature(2, 1, (Neuron("output", "output-0", 0.0),), (Synapse("input-2", "output-0", 1.0), Synapse("input-1", "input-0", 1.0), Synapse("input-99999999999", "output-0", 1.0)))
    rows = graph.resolved(K.creature_table(spark, {"odd": odd})).orderBy("at").collect()
    assert [(r.source, r.target) for r in rows] == [(None, 2), (1, None), (None, 2)]
    assert {r.from_uuid for r in validation.unlisted_sources(K.creature_table(spark, {"odd": odd})).collect()} == {"input-2", "input-99999999999"}


def test_a_table_scores_like_the_same_creatures_on_the_driver(spark, data, tmp_path):
    rng = np.random.default_rng(6)
    df = corpus(spark, rng.uniform(-1, 1, (700, 3)), rng.uniform(0, 1, 700), 3)
    C.write_bin(df, f"{tmp_path}/bin", 2)
    table = derived.supplier_population(spark, data)
    want = {r.key: r for r in score_population(df, held(table), "RMSE", 0.5, 3, tier="arrow").collect()}
    for limit, tile in ((16 << 20, 1 << 20), (0, 64)):
        for source in (df, f"{tmp_path}/bin"):
            assert {r.key: r for r in score_table(source, table, "RMSE", 0.5, 3, limit=limit, tile=tile).collect()} == want
    with pytest.raises(Exception, match="no records"):
        score_table(df.where("false"), table).collect()
    with pytest.raises(CreatureError, match="narrow has 2 inputs"):
        score_table(df, K.creature_table(spark, {k: FAULTY[k] for k in ("good", "narrow")}))
    with pytest.raises(Exception, match="nowhere"):
        score_table(df, K.creature_table(spark, {k: FAULTY[k] for k in ("good", "dangling")})).collect()
    with pytest.raises(CreatureError, match="no creatures"):
        score_table(df, table.where("false"))


def test_equal_records_are_scored_once(spark, data):
    rng = np.random.default_rng(8)
    x, t = rng.uniform(-1, 1, (300, 3)).astype("f4"), rng.uniform(0, 1, 300).astype("f4")
    x[:4], t[:4] = [[0.0, 0.5, 1.0], [-0.0, 0.5, 1.0]] * 2, 0.25
    times = rng.integers(1, 20, 300)
    df = corpus(spark, np.repeat(x, times, 0), np.repeat(t, times), 7)
    assert arrow_tier.combined(df, 3, 1).agg(F.count("*"), F.sum("n")).first() == (298, times.sum())
    table = derived.supplier_population(spark, data)
    want = {r.key: r for r in score_population(df, held(table), tier="arrow").collect()}
    assert {r.key: r for r in score_table(df, table).collect()} == want and all(r.record_count == times.sum() for r in want.values())


def test_ranking_makes_its_scores_once(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    scores = spark.range(0, 500, 1, 3).select(F.col("id").alias("key"), (F.col("id") % 7).alias("error")).mapInArrow(rows, "key long, error long")
    got = ranking.ranked_by_range(scores, "error").collect()
    assert {(r.error, r.rank_no) for r in got} == {(e, 1 + sum(1 for k in range(500) if k % 7 < e)) for e in range(7)} and len(got) == 500
    assert made.value == 500


def test_a_folder_of_creatures_as_a_table(spark, tmp_path):
    folder = C.new_folder(spark, "creatures")
    K.write_creatures(POPULATION, C.text_writer(folder))
    table = K.read_creature_table(spark, folder)
    assert {r.key: r.creature_index for r in table.collect()} == {k: i for i, k in enumerate(sorted(POPULATION))}
    assert held(table) == POPULATION
    assert held(K.parsed_table(K.json_table(table)).join(table.select("key", "creature_index", "semantic_version"), "key").select("creature_index", "key", "input", "output", "forward_only", "semantic_version", F.transform("neurons", lambda n: F.struct(n["uuid"].alias("uuid"), n["type"].alias("type"), n["bias"].alias("bias"), n["squash"].alias("squash"))).alias("neurons"), F.transform("synapses", lambda s: F.struct(s["fromUUID"].alias("from_uuid"), s["toUUID"].alias("to_uuid"), s["weight"].alias("weight"), s["type"].alias("type"))).alias("synapses"))) == POPULATION
    C.text_writer(folder)("bad.json", "{")
    with pytest.raises(Exception, match="bad.json"):
        K.read_creature_table(spark, folder).collect()


def test_ranks_equal_those_of_one_window(spark):
    rows = [(f"k{i}", None if i % 50 == 0 else float(i % 7) if i % 3 else 1.5) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, error double")
    want = {r.key: r.r for r in df.withColumn("r", F.rank().over(Window.orderBy("error"))).collect()}
    got = ranking.ranked_by_range(df, "error")
    assert {r.key: r.rank_no for r in got.collect()} == want and "SinglePartition" not in got._jdf.queryExecution().toString()
    fine = spark.createDataFrame([(f"k{i}", float(i)) for i in range(500)], "key string, error double")
    small = ranking.running_totals(fine.withColumn("one", F.lit(2)), "error", "one", "before", rows_in_range=20)
    assert {r.key: r.before for r in small.collect()} == {f"k{i}": 2 * i for i in range(500)}
    assert ranking.ranked_by_range(df.where("false"), "error").count() == 0
    assert [r.key for r in ranking.least(fine, 3).collect()] == ["k0", "k1", "k2"]
    assert {r.key for r in ranking.least(fine.withColumn("g", F.expr("substring(key, 2, 1)")), 1, ["g"]).collect()} == {f"k{i}" for i in range(10)}


@pytest.mark.parametrize("rate,phase", [(1.0, 0), (0.5, 1), (0.25, 0), (0.03, 7), (0.001, 3), (1 / 3, 2), (0.0999, 12345)])
def test_sampled_spans_are_those_of_the_rule(spark, tmp_path, rate, phase, monkeypatch):
    rows = np.arange(5000 * 4, dtype="<f4").reshape(-1, 4)
    for i, part in enumerate(np.split(rows, [1000, 1001, 3500])):
        part.tofile(f"{tmp_path}/{i}.bin")
    monkeypatch.setattr(C, "GAP", 64)  # four records
    read = []
    real = C.unpack
    monkeypatch.setattr(C, "unpack", lambda data, width: read.append(len(data)) or real(data, width))
    j = np.arange(5000, dtype=np.float64) + phase
    want = rows[np.floor((j + 1) * rate) > np.floor(j * rate)] if rate < 1 else rows
    for split in (1 << 20, 777):
        read.clear()
        found = [x for part in C.byte_ranges(str(tmp_path), 4, split) for x in C.kept_records(str(tmp_path), part, 4, 100, rate, phase)]
        assert (np.vstack(found) == want).all()
        assert rate > 0.2 or sum(read) <= 16 * (len(want) + 4)


def test_a_stream_of_packed_records_stopped_and_started_again(spark, tmp_path):
    rng = np.random.default_rng(9)
    values = rng.uniform(-1, 1, (900, 4)).astype("<f4")
    (tmp_path / "bin").mkdir()

    def grow(name, rows, more=b""):
        with open(tmp_path / "bin" / name, "ab") as f:
            f.write(rows.tobytes() + more)

    def run():
        stream = C.stream_bin(spark, f"{tmp_path}/bin", 3, 1, split=1600)
        racing.stream_units(stream, POPULATION, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()

    grow("1.bin", values[:300])
    run()
    cut = values[400:401].tobytes()
    grow("2.bin", values[300:400], cut[:5])  # a record half written
    run()
    with open(tmp_path / "bin" / "2.bin", "ab") as f:
        f.write(cut[5:])
    grow("1.bin", values[401:600])
    grow("10.bin", values[600:])
    run()
    run()
    lines = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    got = {(r.key, r.loss_sum, r.n) for r in totals(lines, list(POPULATION)).collect()}
    want = {(r.key, r.loss_sum, r.n) for r in partials(C.read_bin(spark, f"{tmp_path}/bin", 3, 1), POPULATION, "MSE", "arrow").collect()}
    assert got == want and {n for _, _, n in got} == {900}


def _abandon(rows):
    best = min(r.partial_error for r in rows)
    return {r.index for r in rows if r.partial_error > 3.0 * best}


@pytest.mark.parametrize("callback", [_abandon, lambda rows: racing.CONTINUE, lambda rows: racing.ABORT_ALL, lambda rows: {r.index for r in rows}])
def test_a_race_in_one_query_equals_the_race(spark, callback):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (1000, 2))
    df = corpus(spark, x, 0.3 * x[:, 0] + 0.05 * x[:, 1])
    for cost in ("MSE", "RMSE"):
        want = {r.key: (r.error, r.record_count) for r in racing.race(df, RACERS, callback, 170, cost, tier="sql", records=1000).collect()}
        got = {r.key: (r.error, r.record_count) for r in racing.race_in_one_query(df, RACERS, callback, 170, cost).collect()}
        assert got == want and len(got) == 4


def test_checks_name_what_is_wrong(spark):
    table = K.creature_table(spark, {"none": Creature(0, 1, (Neuron("output", "output-0", 0.0),), ()), "two": Creature(1, 2, (Neuron("output", "output-0", 0.0, "MEAN"),), ()), "wide": K.linear([0.1] * 5)})
    assert {(r.key, r.fault) for r in validation.declared_widths(table, 5).collect()} == {("none", "input"), ("two", "outputs listed"), ("wide", "too wide")}
    assert [(r.key, r.squash) for r in validation.refused_squashes(table).collect()] == [("two", "MEAN")]
    rows = [Row(record_idx=i, features=f, targets=t) for i, (f, t) in enumerate([([1.0, 2.0], [1.0]), ([1.0], [1.0]), (None, [1.0]), ([1.0, None], [1.0]), ([1.0, math.nan], []), ([1.0, 2.0], [None])])]
    bad = validation.bad_records(spark.createDataFrame(rows, "record_idx long, features array<float>, targets array<float>"), 2, 1)
    assert {r.record_idx: r.fault for r in bad.collect()} == {1: "features length", 2: "no features", 3: "null in features", 4: "targets length", 5: "null in targets"}


def test_unlisted_sources_are_found_within_the_row(spark, data):
    table = derived.part_population(spark, data)
    odd = Creature(2, 1, (Neuron("output", "output-0", 0.0),), tuple(Synapse(x, "output-0", 1.0) for x in ("input-1", "input-2", "output-0", "gone", "gone", None)))
    table = table.unionByName(K.creature_table(spark, {"odd": odd, "bare": Creature(2, 1, (), (Synapse("input-0", "h", 1.0), Synapse("h", "h", 1.0)))}))
    found = validation.unlisted_sources(table)
    want = graph.resolved(table).where("source IS NULL").join(table.select("key", F.posexplode("synapses").alias("at", "s")), ["key", "at"]).select("key", "s.from_uuid", "s.to_uuid")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.where("key = 'odd'").count() == 4
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_file_sums_do_not_depend_on_the_cut(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = (rng.uniform(-1, 1, (3000, 4)) * 10.0 ** rng.integers(-6, 6, (3000, 1))).astype("<f4")
    for i, part in enumerate(np.split(rows, [1000, 1700])):
        part.tofile(f"{tmp_path}/{i}.bin")
    seen = {tuple((r.file_idx, r.n, r.total, r.running) for r in C.file_sums(C.read_bin(spark, str(tmp_path), 3, 1, split)).orderBy("file_idx").collect()) for split in (1 << 20, 999, 4000)}
    assert len(seen) == 1 and [n for _, n, _, _ in seen.pop()] == [1000, 700, 1300]


def relatives(n):
    """Creatures of one and of two hidden neurons, both of kinds that recur: five weights and two biases."""
    out = []
    for i in range(n):
        hidden = [(Neuron("hidden", f"h{j}", 0.1 * (1 + i % 2) * (1 + j), "TANH"), [Synapse(f"input-{k}", f"h{j}", 0.2 * (i % 5) - 0.3 * k + 0.1 * j) for k in range(3)]) for j in range(1 + i % 3 % 2)]
        out.append(Creature(3, 1, (*(h for h, _ in hidden), Neuron("output", "output-0", 0.01 * i)), (*(s for _, own in hidden for s in own), *(Synapse(h.uuid, "output-0", 0.3 - 0.01 * i) for h, _ in hidden))))
    return out


class Told:
    """Tiles as a task sees them, broadcast or one by one."""

    files = ()

    def __init__(self, cut, held):
        self.cut, self.value, self.creatures = cut, True if held else None, sum(len(t.numbers) for t in cut)

    def tiles(self):
        return iter(self.cut)


@pytest.mark.parametrize("held", [True, False])
def test_neurons_that_creatures_share_are_worked_out_once(monkeypatch, held):
    rng, networks, worked = np.random.default_rng(4), [compile_creature(c) for c in relatives(60)], []
    x, t, n = rng.uniform(-1, 1, (50, 3)).astype("f4"), rng.uniform(0, 1, (50, 1)).astype("f4"), rng.integers(1, 4, 50)
    plain = arrow_tier.limited_in_place
    monkeypatch.setattr(arrow_tier, "limited_in_place", lambda squash, z: (worked.append(z.size // 50 if squash.name == "TANH" else 0), plain(squash, z)))

    def lines(cut, held=True):
        scorer = arrow_tier.Scorer(Told(cut, held), "MSE", 4)
        scorer.add(x, t, n)
        return {(r["key"], r["exp"], r["units"], r["n"]) for b in scorer.lines() for r in b.to_pylist()}

    got = lines(arrow_tier.tiles(networks), held)
    assert sum(worked) == (20 if held else 30)  # ten of each place; a tile has one topology
    one = [line for i, net in enumerate(networks) for line in lines([arrow_tier.Tile(*(lambda tile: (tile.topology, [i], tile.bias, tile.weights))(arrow_tier.tiles([net])[0]))])]
    assert got == set(one) and len({k for k, *_ in got}) == 60


def test_more_shared_neurons_than_are_held_at_once(monkeypatch):
    networks = [compile_creature(c) for c in relatives(60)]
    rng = np.random.default_rng(4)
    x, t, seen = rng.uniform(-1, 1, (5000, 3)).astype("f4"), rng.uniform(0, 1, (5000, 1)).astype("f4"), []
    for most in (1, 3, 64):
        monkeypatch.setattr(arrow_tier, "NEURONS", most)
        scorer = arrow_tier.Scorer(Told(arrow_tier.tiles(networks), True), "MAE", 4)
        scorer.add(x, t)
        scorer.add(x[:0], t[:0])
        seen.append({(r["key"], r["exp"], r["units"], r["n"]) for b in scorer.lines() for r in b.to_pylist()})
    assert seen[0] == seen[1] == seen[2]


def test_creatures_are_compiled_once_and_by_many_tasks(spark, data, monkeypatch):
    rows, tasks, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), population._compile

    def counted(batches):
        n = 0
        for batch in batches:
            n += batch.num_rows
            yield from plain([batch])
        rows.add(n)
        tasks.add(1 if n else 0)

    monkeypatch.setattr(population, "_compile", counted)
    table = derived.supplier_population(spark, data)
    assert population.shared_table(table)[0].creatures == table.count() == rows.value and tasks.value > 1
