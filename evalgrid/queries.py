"""The registered queries of the scorer over the driver's tables, and the SQL that must give the same rows.

Each query runs the library's own expressions; the SQL below is written against the formulas and shares nothing with
them but the creatures' weights.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import penalties as P
from .functions.losses import COSTS
from .functions.squash import SQUASHES, UnsupportedSquash, limited, squash_of
from .operators import graph, ranking, validation
from .operators.sampling import sample
from .operators.scoring import components, errors, partials, result_json, score_bin, score_population, score_table
from .plans import sql_tier
from .plans.creature import Creature, CreatureError, Neuron, Synapse, compile_creature, emit_creature, parse_creature, validate
from .sources import corpus as C
from .sources import creatures as K
from .sources import derived as D
from .streaming import racing

Query = Callable[[SparkSession, str], DataFrame]

# Creatures of the queries.
LINE = K.linear([0.3, 0.2, 0.5], 0.01)
TWO_BIAS = (0.1, 0.0)
TWO_WEIGHTS = [[((i * 7 + o * 5) % 13 - 6) / 20 for i in range(64)] for o in range(2)]
TWO = Creature(64, 2, (Neuron("output", "output-0", TWO_BIAS[0], "TANH"), Neuron("output", "output-1", TWO_BIAS[1], "LOGISTIC")), tuple(Synapse(f"input-{i}", f"output-{o}", w) for o, own in enumerate(TWO_WEIGHTS) for i, w in enumerate(own)))
POPULATION = {f"line-{i}": K.linear([0.3 + 0.15 * i, 0.2, 0.1 * i], 0.01) for i in range(3)} | {"dense": K.dense(3, 4, 1)}


def _into(kind: str, synapses, neurons=(), bias: float = 0.25) -> Creature:
    own = (*neurons, Neuron("hidden", "h", bias, kind), Neuron("output", "output-0", 0.0, "IDENTITY"))
    return Creature(3, 1, own, (*synapses, Synapse("h", "output-0", 1.0)), semantic_version="4.0.0")


_ALL = tuple(Synapse(f"input-{i}", "h", w) for i, w in enumerate((0.5, 0.8, -2.0)))
_ROLES = (Synapse("input-0", "h", 1.0, "condition"), Synapse("one", "h", -0.5, "condition"), Synapse("input-1", "h", 0.75, "positive"), Synapse("input-2", "h", 3.0, "negative"))
_ONE = (Neuron("constant", "one", 1.0),)
NETWORKS = {
    "agg_minimum": _into("MINIMUM", _ALL),
    "agg_maximum": _into("MAXIMUM", _ALL),
    "agg_if": _into("IF", _ROLES, _ONE),
    "agg_if_boundary": _into("IF", (Synapse("input-0", "h", 2.0, "condition"), Synapse("one", "h", -1.0, "condition"), Synapse("one", "h", 1.0, "positive"), Synapse("one", "h", -1.0, "negative")), _ONE, 0.0),
    "constant_neuron": Creature(3, 1, (Neuron("constant", "one", 0.04), Neuron("output", "output-0", 0.0, "IDENTITY")), (Synapse("one", "output-0", 1.0),)),
    "fwd_dense_mlp": K.dense(3, 8, 1),
    "fwd_tree_depth1": K.decision_tree([(0, 0.5)], [0.02, 0.06], 3),
    "fwd_tree_depth3": K.decision_tree([(0, 0.5), (1, 0.3), (2, 0.05), (1, 0.15), (0, 0.25), (2, 0.025), (0, 0.75)], [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08], 3),
    "fwd_dual_role": _into("IF", (Synapse("input-0", "h", 1.0, "condition"), Synapse("one", "h", -0.5, "condition"), Synapse("input-0", "h", 0.1, "positive"), Synapse("input-0", "h", 0.2, "negative")), _ONE, 0.0),
    "fwd_recurrent_reset": Creature(3, 1, (Neuron("hidden", "h", 0.0, "IDENTITY"), Neuron("output", "output-0", 0.0, "IDENTITY")), (Synapse("input-0", "h", 0.5), Synapse("output-0", "h", 0.5), Synapse("h", "output-0", 1.0)), forward_only=False),
}
#: Creatures that are refused, by name; faults are theirs by intent.
FAULTY = {
    "good": LINE,
    "dangling": Creature(3, 1, LINE.neurons, (*LINE.synapses, Synapse("input-0", "nowhere", 1.0), Synapse("input-0", "input-1", 1.0))),
    "twice": Creature(3, 1, LINE.neurons, (*LINE.synapses, LINE.synapses[0], Synapse("input-1", "output-0", 0.5, "positive"))),
    "narrow": K.linear([0.1, 0.2], 0.0),
    "infinite": Creature(3, 1, (Neuron("hidden", "h", math.nan, "TANH"), LINE.neurons[0]), (Synapse("input-0", "h", math.inf), Synapse("h", "output-0", 1.0), Synapse("input-1", "output-0", -math.inf))),
}
RACERS = {f"line-{i}": K.linear([0.1 + 0.2 * i, 0.05]) for i in range(4)}
CHUNK = 500


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _loss(cost: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if cost == "CATEGORICAL_ERROR":
            corpus, creature = C.embeddings_corpus(spark, sf_dir), TWO
        else:
            corpus, creature = C.lineitem_unordered(spark, sf_dir), LINE
        tier = "arrow" if cost == "CATEGORICAL_ERROR" else "sql"  # 64 inputs
        out = errors(partials(corpus, {"c": creature}, cost, tier), cost)
        if cost == "MAPE":  # a zero target makes a term of 1e14, so what is compared is the logarithm
            out = out.withColumn("error", F.log10("error"))
        return _rounded(out, "error")

    return run


def _squash(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", F.array(((F.col("l_quantity") - 25.5) / 10).cast("float")).alias("features"))
        out = sql_tier.outputs(t, compile_creature(K.linear([1.0], squash=name)), ("l_quantity",))
        y = F.col("outputs")[0].cast("double")
        return _rounded(out.groupBy("l_quantity").agg(F.count("*").alias("n"), F.min(y).alias("low"), F.max(y).alias("high")), "low", "high", places=4)

    return run


def _network(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(errors(partials(C.lineitem_unordered(spark, sf_dir), {name: NETWORKS[name]}, "MSE", "sql"), "MSE"), "error")

    return run


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_population(C.lineitem_unordered(spark, sf_dir), POPULATION, tier="sql")


def population_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_population(spark, sf_dir), "score", "error").withColumn("complexity_penalty", F.round(F.col("complexity_penalty") * 1e6, 4)).drop("sample_rate")


def population_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_population(spark, sf_dir)).select("key", F.round("error", 6).alias("error"), "rank_no")


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.best(_population(spark, sf_dir)), "error")


def population_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same population in Arrow batches."""
    return _rounded(score_population(C.lineitem_unordered(spark, sf_dir), POPULATION, tier="arrow").select("key", "error", "record_count"), "error")


def population_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over lineitem as a binary corpus, a sample of it, scored where its bytes are read."""
    path = _bin_corpus(spark, C.lineitem_corpus(spark, sf_dir))
    return score_bin(spark, POPULATION, path, sample_rate=0.3, sample_phase=2).select("key", F.round("error", 6).alias("error"), "record_count")


def _sampled(rate: float, phase: int = 0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(score_population(C.lineitem_corpus(spark, sf_dir), {"c": LINE}, sample_rate=rate, sample_phase=phase, tier="sql").select("key", "error", "record_count", "sample_rate"), "error")

    return run


def sample_index_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(C.lineitem_corpus(spark, sf_dir), 0.3, 2).select("record_idx")


def weight_bias_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all creatures derived from part that have no value which is not finite."""
    parts = D.part_population(spark, sf_dir)
    sound = parts.join(validation.non_finite(parts).select("key").distinct(), "key", "left_anti")
    return _rounded(components(sound).drop("forward_only", "semantic_version"), "max_weight_bias", "avg_weight_bias", "mean_value_penalty", places=6)


def value_penalty_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties of lineitem's prices to the power of their line number, by sign and size: up to 1e35, beyond the clamp."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", F.pow("l_extendedprice", "l_linenumber").alias("m"))
    t = t.withColumn("p", P.magnitude_penalty_column(F.when(F.col("l_linenumber") % 2 == 0, -F.col("m")).otherwise(F.col("m"))))
    return t.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.min("p"), 9).alias("low"), F.round(F.max("p"), 9).alias("high"), F.round(F.avg("p"), 9).alias("mean"))


def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of suppliers: an error by account balance, complexity by nation, versions by key."""
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    version = F.when(F.col("s_suppkey") % 3 == 0, "4.1.0").when(F.col("s_suppkey") % 3 == 1, "3.0.0")
    rows = t.select("s_suppkey", (F.abs("s_acctbal") / 10000).alias("error"), (F.col("s_nationkey") * 1e-6).alias("complexity"), version.alias("version"))
    return rows.select("s_suppkey", F.round(P.score_column(F.col("error"), F.col("complexity"), P.version_penalty_column(F.col("version"))), 9).alias("score"))


def _faults(check) -> Query:
    return lambda spark, sf_dir: check(D.part_population(spark, sf_dir))


def bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem's records, some of them cut, lengthened or emptied by a rule on their values, and what is wrong with them."""
    return validation.bad_records(_spoiled(C.lineitem_corpus(spark, sf_dir)), 3, 1)


def _spoiled(corpus: DataFrame) -> DataFrame:
    i = F.col("record_idx") % 1000
    features = F.when(i == 1, F.slice("features", 1, 2)).when(i == 2, F.concat("features", "targets")).when(i == 3, F.transform("features", lambda x: F.when(x < 1, x))).when(i != 4, F.col("features"))
    targets = F.when(i == 5, F.concat("targets", "targets")).when(i == 6, F.array(F.lit(None).cast("float"))).when(i != 7, F.col("targets"))
    return corpus.select("record_idx", features.alias("features"), targets.alias("targets"))


def network_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the creatures of suppliers: sources resolved by a join, levels by peeling."""
    suppliers = D.supplier_population(spark, sf_dir)
    edges = graph.resolved(suppliers).groupBy("key", F.col("target").alias("node")).agg(F.count("*").alias("n_sources"), F.sum("source").alias("source_sum"))
    return graph.levels(suppliers).join(edges, ["key", "node"])


def supplier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A creature for each supplier, compiled on the executors, over all of lineitem in one pass."""
    out = score_table(C.lineitem_unordered(spark, sf_dir), D.supplier_population(spark, sf_dir))
    out = _rounded(out, "score", "error").withColumn("complexity_penalty", F.round(F.col("complexity_penalty") * 1e6, 4))
    return out.select("key", "score", "error", "complexity_penalty", "record_count", "hidden_neurons", "synapse_count")


def supplier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same population ranked by error to six places, so that there are ties, without a window over all of it."""
    scores = score_table(C.lineitem_unordered(spark, sf_dir), D.supplier_population(spark, sf_dir)).select("key", F.round("error", 6).alias("error"))
    return ranking.ranked_by_range(scores, "error")


def supplier_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten suppliers of least balance of each nation, the smaller key first."""
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("error"))
    return ranking.least(t, 10, ["nation"])


def _event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = sql_tier.losses(C.events_corpus(spark, sf_dir), [compile_creature(c) for c in RACERS.values()], "MSE", ("record_idx",))
    stacked = losses.select("record_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"loss_{i}").alias("loss")) for i, k in enumerate(RACERS)])).alias("r")).select("record_idx", "r.*")
    return ranking.running_means(racing.chunk_sums(stacked, CHUNK))


def chunk_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_event_chunks(spark, sf_dir), "partial_error")


def race_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(racing.survivors(_event_chunks(spark, sf_dir).drop("records_scored"), 3.0), "partial_error")


def float_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.float_scan(C.lineitem_unordered(spark, sf_dir)), "total", places=2)


def bin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, all elements, written as a binary corpus of four shards to a folder of its own and read back."""
    path = C.new_folder(spark, "corpus")
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("record_idx"), F.col("embedding").cast("array<float>").alias("features"), F.array(F.col("label").cast("float")).alias("targets"))
    width = t.agg(F.max(F.size("features"))).first()[0] or 0
    C.write_bin(t, path, 4)
    x = F.transform("features", lambda v: v.cast("double"))
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return C.read_bin(spark, path, width, 1).select("record_idx", F.round(x[0], 6).alias("x0"), F.round(weighted, 4).alias("weighted_sum"), F.col("targets")[0].cast("double").alias("t"))


def _bin_corpus(spark: SparkSession, corpus: DataFrame) -> str:
    path = C.new_folder(spark, "corpus")
    C.write_bin(corpus, path, 4)
    return path


def _race(factor: float) -> Query:
    """Events as a binary corpus, raced in five chunks; a creature whose partial error is over `factor` times the best of
    those active is abandoned."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _bin_corpus(spark, C.events_corpus(spark, sf_dir))
        n = C.record_count(path, 2, 1)

        def referee(rows):
            best = min(r.partial_error for r in rows)
            return {r.index for r in rows if r.partial_error > factor * best}

        out = racing.race(C.read_bin(spark, path, 2, 1), RACERS, referee, n // 5 + 1, tier="sql", records=n)
        return _rounded(out.select("key", "error", "record_count"), "error")

    return run


def race_one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_abandon over the table itself, as one lazy plan."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    def referee(rows):
        best = min(r.partial_error for r in rows)
        return {r.index for r in rows if r.partial_error > 3.0 * best}

    out = racing.race_in_one_query(C.events_corpus(spark, sf_dir), RACERS, referee, n // 5 + 1)
    return _rounded(out.select("key", "error", "record_count"), "error")


def score_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of creature files, in the order of their names, against lineitem as a binary corpus."""
    folder = C.new_folder(spark, "creatures")
    K.write_creatures(POPULATION, C.text_writer(folder))
    creatures = K.read_creatures(spark, folder)
    order = spark.createDataFrame(list(zip(creatures, range(1, len(creatures) + 1))), "key string, n int")
    scores = score_bin(spark, creatures, _bin_corpus(spark, C.lineitem_corpus(spark, sf_dir)), tier="sql")
    return _rounded(scores.join(F.broadcast(order), "key").select("n", "key", "error", "record_count"), "error")


def score_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed result object, and that of one creature given as text, read back as rows; places: the keys' order."""
    path = _bin_corpus(spark, C.lineitem_corpus(spark, sf_dir))
    keyed = json.loads(result_json(score_bin(spark, POPULATION, path, tier="sql")))
    one = json.loads(result_json(score_bin(spark, emit_creature(LINE), path, tier="sql"), keyed=False))
    rows = [(k, i, v["error"], v["recordCount"]) for i, (k, v) in enumerate([*keyed.items(), ("one", one)])]
    return _rounded(spark.createDataFrame(rows, "key string, place int, error double, record_count long"), "error")


def recurrent_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _bin_corpus(spark, C.lineitem_corpus(spark, sf_dir))
    return _rounded(errors(partials(C.read_bin(spark, path, 3, 1), {"fwd_recurrent_reset": NETWORKS["fwd_recurrent_reset"]}, "MSE", "sql"), "MSE"), "error")


def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of lineitem's values by file of a binary corpus, folded in the order of the files."""
    return _rounded(C.file_sums(C.read_bin(spark, _bin_corpus(spark, C.lineitem_corpus(spark, sf_dir)), 3, 1)), "total", places=2).agg(F.sum("n").alias("n"), F.round(F.max("running"), 2).alias("total"))


def squash_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every activation over inputs up to 39 and up to 784; what is compared is ln(1 + |y|) with the sign of y. Adding zero
    after rounding leaves no negative zero."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity")
    columns, rows = [], []
    for scale in SCALES:
        x = ((F.col("l_quantity") - 25.5) * scale).cast("float")
        for i, (name, s) in enumerate(SQUASHES.items()):
            y = limited(s, x).cast("double")
            y = F.signum(y) * F.log1p(F.abs(y))
            at = f"{i}_{scale}"
            columns += [F.min(y).alias(f"low_{at}"), F.max(y).alias(f"high_{at}")]
            rows.append(F.struct(F.lit(name).alias("squash"), F.lit(float(scale)).alias("scale"), (F.round(F.col(f"`low_{at}`"), 4) + 0.0).alias("low"), (F.round(F.col(f"`high_{at}`"), 4) + 0.0).alias("high")))
    return t.agg(*columns).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


SCALES = (1.6, 32.0)


def _guards(sf_dir: str = "") -> dict[str, Callable[[SparkSession], object]]:
    """What must be refused, by name."""
    line = {"c": LINE}

    def changed(features=lambda x: x, targets=lambda t: t):
        """All of lineitem, records of quantity 7 being changed."""

        def corpus(spark):
            own = F.round(F.col("features")[0] * 50) == 7
            rows = C.lineitem_unordered(spark, sf_dir)
            return rows.select(F.when(own, features(F.col("features"))).otherwise(F.col("features")).alias("features"), F.when(own, targets(F.col("targets"))).otherwise(F.col("targets")).alias("targets"))

        return corpus

    def whole(spark):
        return C.lineitem_unordered(spark, sf_dir)

    def broken_bin(spark):
        """Lineitem as a binary corpus, a file of which has a byte too many."""
        path = _bin_corpus(spark, C.lineitem_corpus(spark, sf_dir))
        C.append_bytes(path, "0.bin", b"x")
        return path

    def folder(*files: int):
        def path(spark):
            out = C.new_folder(spark, "guard")
            write = C.text_writer(out)
            for i, n in enumerate(files):
                write(f"{i}.bin", "x" * n)
            return out

        return path

    first_null = lambda x: F.transform(x, lambda v, i: F.when(i != 0, v))
    records = (("short record", changed(lambda x: F.slice(x, 1, 2))), ("long record", changed(lambda x: F.concat(x, x))), ("null value", changed(first_null)), ("long target", changed(targets=lambda t: F.concat(t, t))), ("null target", changed(targets=first_null)))
    out = {f"rate {r}": (lambda spark, r=r: sample(whole(spark), r)) for r in (0.0, -0.5, 1.5, math.nan, math.inf)}
    out |= {f"{tier}: {name}": (lambda spark, tier=tier, rows=rows: partials(rows(spark), line, "MSE", tier).collect()) for tier in ("sql", "arrow") for name, rows in records}
    out |= {
        "negative phase": lambda spark: sample(whole(spark), 0.5, -1),
        "unknown cost": lambda spark: partials(whole(spark), line, "mse"),
        "negative mean": lambda spark: score_population(whole(spark), line, "MSLE").collect(),
        "no records": lambda spark: score_population(whole(spark).where("false"), line, tier="sql").collect(),
        "misaligned file": lambda spark: C.read_bin(spark, broken_bin(spark), 3, 1),
        "no files": lambda spark: C.read_bin(spark, folder()(spark), 3, 1),
        "empty files": lambda spark: C.read_bin(spark, folder(0, 0)(spark), 3, 1),
        "no creatures": lambda spark: K.read_creatures(spark, folder(4)(spark)),
        "no folder": lambda spark: C.read_bin(spark, C.new_folder(spark, "absent") + "/none", 3, 1),
        "empty creature": lambda spark: score_bin(spark, " ", "/nowhere"),
        "not JSON": lambda spark: parse_creature("{"),
        "too wide": lambda spark: validate(LINE, max_nodes=3),
        "cycle": lambda spark: compile_creature(Creature(1, 1, (Neuron("hidden", "h", 0.0), Neuron("output", "output-0", 0.0)), (Synapse("input-0", "h", 1.0), Synapse("h", "output-0", 1.0), Synapse("output-0", "h", 1.0)))),
        "shapes differ": lambda spark: score_table(whole(spark), D.part_population(spark, sf_dir)),
        "callback fails": lambda spark: racing.StdioReferee(lambda: "{}", lambda line: None)([]),
    }
    return out | {f"squash {x}": (lambda spark, x=x: squash_of(x)) for x in ("HYPOT", "HYPOTv2", "MEAN", "tanh")} | {f"creature {k}": (lambda spark, k=k: validate(FAULTY[k])) for k in ("dangling", "twice", "infinite")}


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case with whether it was refused as its kind of fault; what is scored is all of lineitem, spoiled in some way. n:
    its records."""
    rows, n = [], F.lit(C.lineitem_unordered(spark, sf_dir).count()).cast("long")
    for name, case in _guards(sf_dir).items():
        try:
            case(spark)
            rows.append((name, False))
        except (ValueError, CreatureError, UnsupportedSquash, C.CorpusError, racing.RacingError):
            rows.append((name, True))
        except Exception as e:  # what a task or an expression raises
            rows.append((name, any(x in str(e) for x in ("corpus records must have", "no records", "cannot be scored"))))
    return spark.createDataFrame(rows, "name string, refused boolean").withColumn("n", n)


def creature_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The creatures of suppliers as JSON and read back, on the executors."""
    out = K.parsed_table(K.json_table(D.supplier_population(spark, sf_dir)))
    return out.select("key", "input", "output", F.size("neurons").alias("n_neurons"), F.size("synapses").alias("n_synapses"), F.round(F.aggregate("synapses", F.lit(0.0), lambda a, s: a + s["weight"]), 9).alias("weight_sum"))


QUERIES: dict[str, Query] = (
    {f"loss_{c.lower()}": _loss(c) for c in COSTS}
    | {f"squash_{s.lower()}": _squash(s) for s in SQUASHES}
    | {n: _network(n) for n in NETWORKS}
    | {
        "population_scores": population_scores,
        "population_rank": population_rank,
        "best_candidate": best_candidate,
        "population_arrow": population_arrow,
        "population_bin": population_bin,
        "sample_half": _sampled(0.5),
        "sample_quarter": _sampled(0.25),
        "sample_phase": _sampled(0.3, 2),
        "sample_index_set": sample_index_set,
        "weight_bias_stats": weight_bias_stats,
        "value_penalty_curve": value_penalty_curve,
        "final_score": final_score,
        "dangling_targets": _faults(validation.dangling_targets),
        "duplicate_synapses": _faults(validation.duplicate_synapses),
        "shape_mismatches": _faults(validation.shape_mismatches),
        "non_finite": _faults(validation.non_finite),
        "declared_widths": _faults(validation.declared_widths),
        "refused_squashes": _faults(validation.refused_squashes),
        "unlisted_sources": _faults(validation.unlisted_sources),
        "bad_records": bad_records,
        "network_levels": network_levels,
        "supplier_scores": supplier_scores,
        "supplier_rank": supplier_rank,
        "supplier_top": supplier_top,
        "guards": guards,
        "race_continue": _race(math.inf),
        "race_abandon": _race(3.0),
        "race_one_query": race_one_query,
        "score_folder": score_folder,
        "score_json": score_json,
        "recurrent_bin": recurrent_bin,
        "ordered_fold": ordered_fold,
        "squash_saturated": squash_saturated,
        "chunk_partials": chunk_partials,
        "race_survivors": race_survivors,
        "float_scan": float_scan,
        "bin_roundtrip": bin_roundtrip,
        "creature_json_roundtrip": creature_json_roundtrip,
    }
)

# ---- SQL ----
_LINEITEM = "SELECT CAST(l_quantity / 50 AS FLOAT) AS x0, CAST(l_extendedprice / 100000 AS FLOAT) AS x1, CAST(l_discount AS FLOAT) AS x2, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS t FROM lineitem"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_INDEXED = f"SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS record_idx FROM lineitem"
_EMBEDDINGS = "SELECT vec_id AS record_idx, embedding AS x, CAST(label % 2 AS DOUBLE) AS t1 FROM embeddings"


def _f(x: float) -> str:
    return f"CAST({x!r} AS FLOAT)"


_LINE_SQL = f"CAST({_f(0.01)} + {_f(0.3)} * x0 + {_f(0.2)} * x1 + {_f(0.5)} * x2 AS DOUBLE)"
_LOSS_SQL = {
    "MSE": "(t - o) * (t - o)", "RMSE": "(t - o) * (t - o)", "MAE": "abs(t - o)", "MAPE": "abs((o - t) / greatest(t, 1e-15))", "MSLE": "ln(greatest(t, 1e-15)) - ln(greatest(o, 1e-15))",
    "HINGE": "greatest(0, 1 - t * o)", "CROSS_ENTROPY": "-(t * ln(least(greatest(o, 1e-15), 1 - 1e-15)) + (1 - t) * ln(1 - least(greatest(o, 1e-15), 1 - 1e-15)))",
}
# The activations as SQL over a DOUBLE x, with the ranges: low, high.
_MAX = "3.4028234663852886e38"
_SOFT = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_SIGMOID = "(1 / (1 + exp(-least(greatest({x}, -30), 30))))"
_SQUASH_SQL = {
    "IDENTITY": ("{x}", "-" + _MAX, _MAX), "RELU": ("greatest({x}, 0)", "0", _MAX), "ReLU6": ("least(6, greatest(0, {x}))", "0", "6"),
    "LeakyReLU": ("CASE WHEN {x} >= 0 THEN {x} ELSE 0.01 * {x} END", "-" + _MAX, _MAX), "SELU": ("1.050701 * CASE WHEN {x} > 0 THEN least({x}, 709) ELSE 1.6732632 * exp({x}) - 1.6732632 END", "-1.7581", _MAX),
    "ELU": ("CASE WHEN {x} > 0 THEN {x} ELSE exp({x}) - 1 END", "-1", _MAX), "LOGISTIC": (_SIGMOID, "0", "1"), "TANH": ("tanh({x})", "-1", "1"), "HARD_TANH": ("least(1, greatest(-1, {x}))", "-1", "1"),
    "SOFTSIGN": ("{x} / (1 + abs({x}))", "-0.98999995", "0.98999995"), "Softplus": (_SOFT, "1e-15", "100"), "Swish": ("{x} * " + _SIGMOID, "-0.278", _MAX), "Mish": ("{x} * tanh(" + _SOFT + ")", "-0.309", _MAX),
    "GELU": ("0.5 * {x} * (1 + tanh(sqrt(2 / pi()) * ({x} + 0.044715 * {x} * {x} * {x})))", "-0.17", _MAX), "SINE": ("sin({x})", "-1", "1"), "Cosine": ("cos({x})", "-1", "1"), "TAN": ("least(1000, greatest(-1000, tan({x})))", "-" + _MAX, _MAX),
    "ArcTan": ("atan({x})", "-1.5707964", "1.5707964"), "GAUSSIAN": ("exp(-{x} * {x})", "0", "1"), "BENT_IDENTITY": ("(sqrt({x} * {x} + 1) - 1) / 2 + {x}", "-" + _MAX, _MAX), "BIPOLAR_SIGMOID": ("2 * " + _SIGMOID + " - 1", "-1", "1"),
    "BIPOLAR": ("CASE WHEN {x} > 0 THEN 1.0 ELSE -1.0 END", "-1", "1"), "STEP": ("CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END", "0", "1"), "COMPLEMENT": ("1 - {x}", "-" + _MAX, _MAX), "ABSOLUTE": ("abs({x})", "0", _MAX),
    "SQUARE": ("least({x} * {x}, 1e6)", "0", _MAX), "Cube": ("least(1e6, greatest(-1e6, {x} * {x} * {x}))", "-" + _MAX, _MAX), "SQRT": ("CASE WHEN {x} >= 0 THEN sqrt(greatest({x}, 0)) ELSE 0 END", "0", _MAX),
    "StdInverse": ("1 / {x}", "-" + _MAX, _MAX), "Exponential": ("CASE WHEN {x} >= 36 THEN 9007199254740992 ELSE exp(least({x}, 36)) END", "0", _MAX), "LogSigmoid": ("CASE WHEN {x} <= -709 THEN -9007199254740992 ELSE -(greatest(-{x}, 0) + ln(1 + exp(-abs({x})))) END", "-" + _MAX, "0"), "ISRU": ("{x} / sqrt(1 + {x} * {x})", "-1", "1"),
}


def _act_sql(squash: str, z: str) -> str:
    form, low, high = _SQUASH_SQL[squash]
    x = f"CAST({z} AS DOUBLE)"
    return f"CAST(greatest(CAST({low} AS DOUBLE), least(CAST({high} AS DOUBLE), CAST({form.format(x=x)} AS DOUBLE))) AS FLOAT)"


def _squash_sql(name: str) -> str:
    return f"SELECT l_quantity, count(*) AS n, round(min(y), 4) AS low, round(max(y), 4) AS high FROM (SELECT l_quantity, CAST({_act_sql(name, 'CAST((l_quantity - 25.5) / 10 AS FLOAT)')} AS DOUBLE) AS y FROM lineitem) GROUP BY l_quantity"


def _error_sql(key: str, output: str, source: str = _LINEITEM, loss: str = "(t - o) * (t - o)", where: str = "true") -> str:
    return f"SELECT '{key}' AS key, round(avg({loss}), 6) AS error, count(*) AS record_count FROM (SELECT t, CAST({output} AS DOUBLE) AS o FROM ({source})) WHERE {where}"


def _loss_sql(cost: str) -> str:
    if cost == "CATEGORICAL_ERROR":
        a, b = (_act_sql(squash, " + ".join([_f(bias), *(f"{_f(w)} * CAST(x[{i + 1}] AS FLOAT)" for i, w in enumerate(own))])) for squash, bias, own in zip(("TANH", "LOGISTIC"), TWO_BIAS, TWO_WEIGHTS, strict=True))
        return f"SELECT 'c' AS key, round(avg(CASE WHEN (t1 > 0.5) = ({b} > {a}) THEN 0.0 ELSE 1.0 END), 6) AS error, count(*) AS record_count FROM ({_EMBEDDINGS})"
    out = _error_sql("c", _LINE_SQL, loss=_LOSS_SQL[cost])
    if cost == "MAPE":
        return out.replace("round(avg(", "round(log10(avg(").replace("), 6)", ")), 6)")
    return out.replace("round(avg(", "round(sqrt(avg(").replace("), 6)", ")), 6)") if cost == "RMSE" else out


def _dense_sql(hidden: int) -> str:
    h = [_act_sql("TANH", " + ".join([_f(0.05)] + [f"{_f(0.05 + 0.001 * (i * hidden + j))} * x{i}" for i in range(3)])) for j in range(hidden)]
    return " + ".join([_f(0.0)] + [f"{_f(0.1 + 0.001 * j)} * {x}" for j, x in enumerate(h)])


_TREE3 = "CASE WHEN x0 > 0.5 THEN CASE WHEN x2 > {c} THEN CASE WHEN x0 > 0.75 THEN 0.08 ELSE 0.07 END ELSE CASE WHEN x2 > {f} THEN 0.06 ELSE 0.05 END END ELSE CASE WHEN x1 > {b} THEN CASE WHEN x0 > 0.25 THEN 0.04 ELSE 0.03 END ELSE CASE WHEN x1 > {d} THEN 0.02 ELSE 0.01 END END END".format(b=_f(0.3), c=_f(0.05), d=_f(0.15), f=_f(0.025))
_NETWORK_SQL = {
    "agg_minimum": f"least({_f(0.5)} * x0, {_f(0.8)} * x1, {_f(-2.0)} * x2) + {_f(0.25)}",
    "agg_maximum": f"greatest({_f(0.5)} * x0, {_f(0.8)} * x1, {_f(-2.0)} * x2) + {_f(0.25)}",
    "agg_if": f"CASE WHEN x0 - {_f(0.5)} > 0 THEN {_f(0.75)} * x1 ELSE {_f(3.0)} * x2 END + {_f(0.25)}",
    "agg_if_boundary": "CASE WHEN x0 > 0.5 THEN 1.0 ELSE -1.0 END",
    "constant_neuron": _f(0.04),
    "fwd_dense_mlp": _dense_sql(8),
    "fwd_tree_depth1": "CASE WHEN x0 > 0.5 THEN 0.06 ELSE 0.02 END",
    "fwd_tree_depth3": _TREE3,
    "fwd_dual_role": f"CASE WHEN x0 > 0.5 THEN {_f(0.1)} * x0 ELSE {_f(0.2)} * x0 END",
    "fwd_recurrent_reset": f"{_f(0.5)} * x0",
}
_POPULATION_SQL = {f"line-{i}": f"{_f(0.01)} + {_f(0.3 + 0.15 * i)} * x0 + {_f(0.2)} * x1 + {_f(0.1 * i)} * x2" for i in range(3)} | {"dense": _dense_sql(4)}
_ERRORS = " UNION ALL ".join(f"SELECT '{k}' AS key, avg((t - o) * (t - o)) AS error, count(*) AS record_count FROM (SELECT t, CAST({x} AS DOUBLE) AS o FROM ({_LINEITEM}))" for k, x in _POPULATION_SQL.items())
# Hidden neurons and synapses of the population; no weight or bias is over 1, so no value is penalised.
_SIZES = "(VALUES ('line-0', 0, 3), ('line-1', 0, 3), ('line-2', 0, 3), ('dense', 4, 16)) AS s(key, h, n)"


def _sample_sql(rate: float, phase: int, key: str = "", output: str = "") -> str:
    source = f"SELECT x0, x1, x2, t FROM (SELECT CAST(l_quantity / 50 AS FLOAT) AS x0, CAST(l_extendedprice / 100000 AS FLOAT) AS x1, CAST(l_discount AS FLOAT) AS x2, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS t, CAST(record_idx + {phase} AS DOUBLE) AS j FROM ({_INDEXED})) WHERE floor((j + 1) * CAST({rate} AS DOUBLE)) > floor(j * CAST({rate} AS DOUBLE))"
    if key:
        return _error_sql(key, output, source)
    return f"SELECT *, CAST({rate} AS DOUBLE) AS sample_rate FROM ({_error_sql('c', _LINE_SQL, source)})"


# The creatures derived from part and from supplier, as tables k(key, i, input, output), n(key, at, uuid, type, squash, bias) and
# s(key, at, f, t, type, weight).
_PARTS = """
WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey AS key, p_size AS size, p_retailprice AS price, p_partkey % 4 = 0 AS branch FROM part),
k AS (SELECT key, k AS i, CASE WHEN k % 151 = 8 THEN 0 WHEN k % 97 = 5 THEN 3 ELSE 2 END AS input, CASE WHEN k % 131 = 7 THEN 0 WHEN k % 137 = 15 THEN 2 ELSE 1 END AS output FROM p),
n AS (SELECT key, 0 AS at_, 'h' AS uuid, 'hidden' AS type, CASE WHEN k % 71 = 11 THEN 'HYPOT' WHEN k % 73 = 12 THEN 'Nope' WHEN branch THEN 'IF' ELSE 'TANH' END AS squash, CASE WHEN k % 61 = 9 THEN CAST('NaN' AS DOUBLE) ELSE size / 10 END AS bias FROM p
  UNION ALL SELECT key, 1, 'output-0', 'output', 'IDENTITY', -price FROM p),
s AS (SELECT key, 0 AS at_, 'input-0' AS f, 'h' AS t, CASE WHEN branch THEN 'condition' END AS type, price AS weight FROM p
  UNION ALL SELECT key, 1, 'input-1', 'h', CASE WHEN branch THEN 'negative' END, -size / 3 FROM p
  UNION ALL SELECT key, 2, 'h', 'output-0', NULL, CASE WHEN k % 83 = 13 THEN CAST('Infinity' AS DOUBLE) ELSE 0.5 END FROM p
  UNION ALL SELECT key, 3, 'input-0', 'nowhere', NULL, 1 FROM p WHERE k % 53 = 3
  UNION ALL SELECT key, 4, 'input-0', 'input-1', NULL, 1 FROM p WHERE k % 59 = 4
  UNION ALL SELECT key, 5, 'input-0', 'h', CASE WHEN branch THEN 'condition' END, price FROM p WHERE k % 67 = 6
  UNION ALL SELECT key, 6, 'input-1', 'output-0', NULL, 0.25 FROM p WHERE k % 79 = 10
  UNION ALL SELECT key, 7, 'input-1', 'output-0', 'positive', 0.75 FROM p WHERE k % 79 = 10
  UNION ALL SELECT key, 8, 'ghost', 'h', CASE WHEN branch THEN 'positive' END, 1 FROM p WHERE k % 89 = 14)
"""
_SUPPLIERS = """
WITH p AS (SELECT s_suppkey AS k, 's' || s_suppkey AS key, s_acctbal AS a, s_suppkey % 3 AS last FROM supplier),
h AS (SELECT *, unnest(range(last + 1)) AS j FROM p),
x AS (SELECT *, unnest(range(3)) AS i FROM h),
s AS (SELECT key, 'h' || j AS target, 3 + j AS node, i AS source, ((k * 7 + j * 3 + i) % 19 - 9) / 10 AS weight FROM x
  UNION ALL SELECT key, 'output-0', 3 + last + 1, 3 + j, ((k + j) % 7 - 3) / 20 FROM h)
"""


def _supplier_sql() -> str:
    """Each supplier's creature over lineitem, neuron by neuron."""
    hidden = []
    for j in range(3):
        w = ", ".join(f"CAST(((k * 7 + {3 * j + i}) % 19 - 9) / 10 AS FLOAT) AS w{j}{i}" for i in range(3))
        hidden.append(f"CAST(a * {j + 1} / 20000 AS FLOAT) AS b{j}, {w}, CAST(((k + {j}) % 7 - 3) / 20 AS FLOAT) AS v{j}")
    act = ", ".join(f"CASE WHEN k % 2 = 0 THEN CAST(tanh(CAST(z{j} AS DOUBLE)) AS FLOAT) ELSE greatest(z{j}, CAST(0 AS FLOAT)) END AS h{j}" for j in range(3))
    z = ", ".join(f"b{j} + w{j}0 * x0 + w{j}1 * x1 + w{j}2 * x2 AS z{j}" for j in range(3))
    out = f"{_f(0.01)} + v0 * h0"
    out = f"CASE last WHEN 0 THEN {out} WHEN 1 THEN {out} + v1 * h1 ELSE {out} + v1 * h1 + v2 * h2 END"
    return f"""SELECT key, any_value(k) AS k, any_value(last) AS last, any_value(a) AS a, avg((t - o) * (t - o)) AS error, count(*) AS record_count FROM (
  SELECT key, k, last, a, t, CAST({out} AS DOUBLE) AS o FROM (SELECT *, {act} FROM (SELECT *, {z} FROM (SELECT key, k, last, a, {", ".join(hidden)} FROM (SELECT s_suppkey AS k, 's' || s_suppkey AS key, s_acctbal AS a, s_suppkey % 3 AS last FROM supplier)), ({_LINEITEM})))) GROUP BY key"""


_STATS_SQL = (
    _PARTS
    + """, v AS (SELECT key, weight AS v FROM s UNION ALL SELECT key, bias FROM n), bad AS (SELECT DISTINCT key FROM v WHERE NOT isfinite(v))
SELECT v.key, CAST(1 AS BIGINT) AS hidden_neurons, (SELECT count(*) FROM s WHERE s.key = v.key) AS synapse_count, round(max(abs(v)), 6) AS max_weight_bias, round(avg(abs(v)), 6) AS avg_weight_bias,
  CAST(3 * (SELECT count(*) FROM n WHERE n.key = v.key AND squash = 'IF') AS DOUBLE) AS squash_penalty, round(avg(CASE WHEN abs(v) <= 1 THEN 0 ELSE 0.999 * log10(abs(v)) / 12 END), 6) AS mean_value_penalty
FROM v WHERE v.key NOT IN (SELECT key FROM bad) GROUP BY v.key"""
)


def _saturated_sql() -> str:
    one = "SELECT '{name}' AS squash, CAST({scale} AS DOUBLE) AS scale, round(min(y), 4) + 0.0::DOUBLE AS low, round(max(y), 4) + 0.0::DOUBLE AS high FROM (SELECT sign(a) * ln(1 + abs(a)) AS y FROM (SELECT CAST({form} AS DOUBLE) AS a FROM lineitem))"
    return " UNION ALL ".join(one.format(name=name, scale=scale, form=_act_sql(name, f"CAST((l_quantity - 25.5) * {scale} AS FLOAT)")) for scale in SCALES for name in SQUASHES)


_CHUNKS = f"""
WITH e AS (SELECT CAST(value / 100 AS FLOAT) AS x0, CAST(hour(ts) / 24.0 AS FLOAT) AS x1, CAST(CAST(value / 200 AS FLOAT) AS DOUBLE) AS t, row_number() OVER (ORDER BY event_id, ts, value) - 1 AS i FROM events),
l AS (SELECT 'line-' || k AS key, CAST(i // {CHUNK} AS BIGINT) AS chunk, t - CAST(CAST(0 AS FLOAT) + CAST(w AS FLOAT) * x0 + CAST(0.05 AS FLOAT) * x1 AS DOUBLE) AS d FROM e, (VALUES (0, 0.1), (1, {0.1 + 0.2!r}), (2, 0.5), (3, {0.1 + 0.2 * 3!r})) AS p(k, w)),
g AS (SELECT key, chunk, sum(d * d) AS s, count(*) AS n FROM l GROUP BY key, chunk),
r AS (SELECT key, chunk, sum(s) OVER w / sum(n) OVER w AS partial_error, CAST(sum(n) OVER w AS BIGINT) AS records_scored FROM g WINDOW w AS (PARTITION BY key ORDER BY chunk ROWS UNBOUNDED PRECEDING))
"""
#: The same in five chunks of the whole corpus.
_RACE = _CHUNKS.replace(f"i // {CHUNK}", "i // ((SELECT count(*) FROM events) // 5 + 1)")
_ABANDON = _RACE + ", b AS (SELECT *, partial_error <= 3.0 * min(partial_error) OVER (PARTITION BY chunk) AS ok FROM r), f AS (SELECT key, coalesce(min(chunk) FILTER (WHERE NOT ok), max(chunk)) AS chunk FROM b GROUP BY key) SELECT key, round(partial_error, 6) AS error, records_scored AS record_count FROM r JOIN f USING (key, chunk)"
ORACLES: dict[str, str] = (
    {f"loss_{c.lower()}": _loss_sql(c) for c in COSTS}
    | {f"squash_{s.lower()}": _squash_sql(s) for s in SQUASHES}
    | {n: _error_sql(n, x) for n, x in _NETWORK_SQL.items()}
    | {
        "population_scores": f"SELECT e.key, round(1 - error - (h * 1e-7 + n * 1e-7 / 10), 6) AS score, round(error, 6) AS error, round((h * 1e-7 + n * 1e-7 / 10) * 1e6, 4) AS complexity_penalty, record_count, CAST(h AS BIGINT) AS hidden_neurons, CAST(n AS BIGINT) AS synapse_count, true AS forward_only, 'MSE' AS cost_name FROM ({_ERRORS}) e JOIN {_SIZES} ON e.key = s.key",
        "population_rank": f"SELECT key, round(error, 6) AS error, CAST(rank() OVER (ORDER BY error) AS INTEGER) AS rank_no FROM ({_ERRORS})",
        "best_candidate": f"SELECT key, round(error, 6) AS error FROM ({_ERRORS}) ORDER BY error, key LIMIT 1",
        "population_arrow": f"SELECT key, round(error, 6) AS error, record_count FROM ({_ERRORS})",
        "population_bin": " UNION ALL ".join(_sample_sql(0.3, 2, k, x) for k, x in _POPULATION_SQL.items()),
        "sample_half": _sample_sql(0.5, 0),
        "sample_quarter": _sample_sql(0.25, 0),
        "sample_phase": _sample_sql(0.3, 2),
        "sample_index_set": f"SELECT record_idx FROM (SELECT record_idx, CAST(record_idx + 2 AS DOUBLE) AS j FROM ({_INDEXED})) WHERE floor((j + 1) * CAST(0.3 AS DOUBLE)) > floor(j * CAST(0.3 AS DOUBLE))",
        "weight_bias_stats": _STATS_SQL,
        "value_penalty_curve": "SELECT l_linenumber, count(*) AS n, round(min(p), 9) AS low, round(max(p), 9) AS high, round(avg(p), 9) AS mean FROM (SELECT l_linenumber, CASE WHEN d < 12 THEN 0.999 * d / 12 ELSE 0.999 + 0.001 * (1 - 12 / d) END AS p FROM (SELECT l_linenumber, log10(least(pow(l_extendedprice, l_linenumber), 9007199254740991)) AS d FROM lineitem)) GROUP BY l_linenumber",
        "final_score": "SELECT s_suppkey, round(1 - abs(s_acctbal) / 10000 - s_nationkey * 1e-6 - CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1e-6 END, 9) AS score FROM supplier",
        "dangling_targets": _PARTS + "SELECT key, f AS from_uuid, t AS to_uuid FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.key = s.key AND n.uuid = s.t)",
        "duplicate_synapses": _PARTS + "SELECT key, f AS from_uuid, t AS to_uuid, 'synapse' AS kind, count(*) AS times FROM s GROUP BY key, f, t, type HAVING count(*) > 1 UNION ALL SELECT s.key, f, t, 'pair', count(*) FROM s JOIN n ON n.key = s.key AND n.uuid = s.t AND n.squash <> 'IF' GROUP BY s.key, f, t HAVING count(*) > 1",
        "shape_mismatches": _PARTS + "SELECT k.key, CAST(k.input AS INTEGER) AS input, CAST(k.output AS INTEGER) AS output FROM k, (SELECT * FROM k ORDER BY i LIMIT 1) AS a WHERE k.input <> a.input OR k.output <> a.output",
        "non_finite": _PARTS + "SELECT key, f || ' -> ' || t AS place FROM s WHERE NOT isfinite(weight) UNION ALL SELECT key, uuid FROM n WHERE NOT isfinite(bias)",
        "declared_widths": _PARTS + "SELECT key, CASE WHEN input < 1 THEN 'input' WHEN output < 1 THEN 'output' ELSE 'outputs listed' END AS fault, CAST(input AS INTEGER) AS input, CAST(output AS INTEGER) AS output, CAST(2 AS INTEGER) AS n_neurons FROM k WHERE input < 1 OR output <> 1",
        "refused_squashes": _PARTS + "SELECT key, uuid, squash FROM n WHERE squash IN ('HYPOT', 'Nope')",
        "unlisted_sources": _PARTS + "SELECT s.key, f AS from_uuid, t AS to_uuid FROM s JOIN k ON k.key = s.key WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.key = s.key AND n.uuid = f) AND NOT (f LIKE 'input-%' AND CAST(substring(f, 7) AS INTEGER) < input)".replace("CAST(substring(f, 7)", "TRY_CAST(substring(f, 7)"),
        "bad_records": f"SELECT record_idx, CASE i WHEN 1 THEN 'features length' WHEN 2 THEN 'features length' WHEN 3 THEN 'null in features' WHEN 4 THEN 'no features' WHEN 5 THEN 'targets length' WHEN 6 THEN 'null in targets' ELSE 'no targets' END AS fault FROM (SELECT record_idx, record_idx % 1000 AS i, l_quantity / 50 AS a, l_extendedprice / 100000 AS b, l_discount AS c FROM ({_INDEXED})) WHERE i BETWEEN 1 AND 7 AND (i <> 3 OR CAST(a AS FLOAT) >= 1 OR CAST(b AS FLOAT) >= 1 OR CAST(c AS FLOAT) >= 1)",
        "network_levels": _SUPPLIERS + "SELECT s.key, CAST(s.node AS INTEGER) AS node, CAST(CASE WHEN any_value(target) = 'output-0' THEN 2 ELSE 1 END AS INTEGER) AS level, count(*) AS n_sources, CAST(sum(source) AS BIGINT) AS source_sum FROM s GROUP BY s.key, s.node",
        "supplier_scores": f"SELECT key, round(1 - error - c - CASE WHEN k % 5 > 1 THEN 0 ELSE 1e-6 END, 6) AS score, round(error, 6) AS error, round(c * 1e6, 4) AS complexity_penalty, record_count, CAST(last + 1 AS BIGINT) AS hidden_neurons, CAST(4 * (last + 1) AS BIGINT) AS synapse_count FROM (SELECT *, CAST(last + 1 AS DOUBLE) * 1.4e-7 + list_sum(list_transform(range(last + 1), lambda j: CASE WHEN abs(a) * (j + 1) > 20000 THEN 0.999::DOUBLE * log10(abs(a) * (j + 1) / 20000) / 12 ELSE 0::DOUBLE END)) / (5 * (last + 1) + 1) * 1e-5 AS c FROM ({_supplier_sql()}))",
        "supplier_rank": f"SELECT key, error, rank() OVER (ORDER BY error) AS rank_no FROM (SELECT key, round(error, 6) AS error FROM ({_supplier_sql()}))",
        "supplier_top": "SELECT s_nationkey AS nation, s_suppkey AS key, s_acctbal AS error FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) <= 10",
        "guards": "SELECT name, true AS refused, (SELECT count(*) FROM lineitem) AS n FROM (VALUES " + ", ".join(f"('{x}')" for x in _guards()) + ") AS v(name)",
        "race_continue": _RACE + "SELECT key, round(partial_error, 6) AS error, records_scored AS record_count FROM r WHERE chunk = (SELECT max(chunk) FROM r)",
        "race_abandon": _ABANDON,
        "race_one_query": _ABANDON,
        "score_folder": f"SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS n, key, round(error, 6) AS error, record_count FROM ({_ERRORS})",
        "score_json": f"SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS place, round(error, 6) AS error, record_count FROM ({_ERRORS} UNION ALL SELECT 'one', avg((t - o) * (t - o)), count(*) FROM (SELECT t, {_LINE_SQL} AS o FROM ({_LINEITEM})))",
        "recurrent_bin": _error_sql("fwd_recurrent_reset", _NETWORK_SQL["fwd_recurrent_reset"]),
        "ordered_fold": f"SELECT count(*) AS n, round(sum(CAST(x0 AS DOUBLE) + CAST(x1 AS DOUBLE) + CAST(x2 AS DOUBLE) + t), 2) AS total FROM ({_LINEITEM})",
        "squash_saturated": _saturated_sql(),
        "chunk_partials": _CHUNKS + "SELECT key, chunk, round(partial_error, 6) AS partial_error, records_scored FROM r",
        "race_survivors": _CHUNKS + ", b AS (SELECT *, partial_error <= 3.0 * min(partial_error) OVER (PARTITION BY chunk) AS ok FROM r) SELECT key, chunk, round(partial_error, 6) AS partial_error, bool_and(ok) OVER (PARTITION BY key ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS alive FROM b",
        "float_scan": f"SELECT round(sum(CAST(x0 AS DOUBLE) + CAST(x1 AS DOUBLE) + CAST(x2 AS DOUBLE) + t), 2) AS total, CAST(4 * count(*) AS BIGINT) AS n_values FROM ({_LINEITEM})",
        "bin_roundtrip": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS record_idx, round(CAST(embedding[1] AS DOUBLE), 6) AS x0, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * i)), 4) AS weighted_sum, CAST(label AS DOUBLE) AS t FROM embeddings",
        "creature_json_roundtrip": _SUPPLIERS + "SELECT key, CAST(3 AS INTEGER) AS input, CAST(1 AS INTEGER) AS output, CAST(count(DISTINCT node) AS INTEGER) AS n_neurons, CAST(count(*) AS INTEGER) AS n_synapses, round(sum(weight), 9) AS weight_sum FROM s GROUP BY key",
    }
)
