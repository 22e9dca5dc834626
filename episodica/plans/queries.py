"""Every operator as a query over the test tables. events are frames: a user is an episode, the event type a task, value and props.k the action."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.functions import text as X
from episodica.functions import vectors as V
from episodica.functions.hashing import normal, uniform
from episodica.operators import alias as A
from episodica.operators import carried as K
from episodica.operators import episodes as E
from episodica.operators import evaluate as Q
from episodica.operators import gradients as G
from episodica.operators import influence as I
from episodica.operators import profile as P
from episodica.operators import quality as D
from episodica.operators import sampling as S
from episodica.operators import selection as C
from episodica.plans.scratch import scratch_folder
from episodica.plans.workflows import repair_files
from episodica.sources import files, sinks
from episodica.sources.datasets import write_dataset
from episodica.sources.filetable import FileTable
from episodica.sources.footers import footers, missing_columns
from episodica.sources.metriclog import log_metrics, read_metrics
from episodica.sources.npy import write_npy
from episodica.sources.pictures import picture_state
from episodica.streaming import streams as R

H = 5
MASK = V.bool_mask(1, -1)
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """ep, event_id, task, v, k, j (place in the episode), n (its length)."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("ep"), "event_id", F.col("event_type").alias("task"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"), "ts"
    )
    return E.number_frames(rows, "ep", ["ts", "event_id"]).drop("ts")


def short_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The same of conversations, whose episodes are short."""
    return E.number_frames(table(spark, sf, "conversations").select(F.col("conv_id").alias("ep"), "turn", "role"), "ep", ["turn"])


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    return E.chunks(frames(spark, sf), "v", H)


def component_stats(spark: SparkSession, sf: str, quantiles: bool = False) -> DataFrame:
    """One row: mean and std, or q01 and q99, of the action's two components as arrays."""
    rows = frames(spark, sf)
    if not quantiles:
        return P.vector_moments(rows.withColumn("a", F.array("v", "k")), "a", 2)
    q = P.histogram_quantiles(P.component_rows(rows.withColumn("a", F.array("v", "k")), "a"), "dim").groupBy("dim").agg(F.min_by("quantile", "p").alias("q01"), F.max_by("quantile", "p").alias("q99"))
    return q.agg(F.sort_array(F.collect_list(F.struct("dim", "q01", "q99"))).alias("s")).select("s.q01", "s.q99")


def with_stats(spark: SparkSession, sf: str, quantiles: bool = False) -> DataFrame:
    return frames(spark, sf).withColumn("a", F.array("v", "k")).crossJoin(F.broadcast(component_stats(spark, sf, quantiles)))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """ep, iter, score: five iterations with signs and zeros.

    Doubles are summed in the order of event_id, however the table is split. A mean that is 49.6 in decimals is a score of 0, which such a sum may
    miss by 1e-14; values that are no decimals below 1e9 (NaN) leave that to the sum.
    """
    rows = table(spark, sf, "events").select(F.col("user_id").alias("ep"), (F.col("event_id") % 5).alias("iter"), "event_id", "value")
    rows = rows.withColumn("off", F.col("value").try_cast("decimal(27,18)") - F.lit(Decimal("49.6")))
    own = Window.partitionBy("ep", "iter").orderBy("event_id", "value")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"sum": F.sum("value"), "n": F.count("value"), "off": F.try_sum("off"), "decimals": F.count("off")}
    e = rows.select("ep", "iter", *(f.over(upto).alias(c) for c, f in sums.items()), F.lead(F.lit(1)).over(own).isNull().alias("last")).where("last")
    zero = ((F.col("ep") + F.col("iter")) % 7 == 0) | ((F.col("off") == 0) & (F.col("decimals") == F.col("n")))
    return e.select("ep", "iter", F.when(zero, 0.0).when(F.col("n") > 0, F.col("sum") / F.col("n") - 49.6).alias("score"))


def mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    return C.mean_of_nonzero(scores(spark, sf), turn="iter")


def r6(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# scans, lookups, projections


@query
def scan_episode_index(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ep")).agg(F.count("*").alias("n"))
    return E.episode_ranges(counts, "ep").select("ep", "n", "start", "end")


@query
def frame_lookup_range_join(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("ep")).agg(F.count("*").alias("n"))
    asked = table(spark, sf, "events").select(F.col("event_id").alias("i"))
    return E.locate_frames(asked, E.episode_ranges(counts, "ep")).select("i", "ep", (F.col("i") - F.col("start")).alias("local"))


@query
def task_lookup(spark, sf):
    """Some rows ask for a task that no text is known of."""
    tasks = table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_index"), F.col("n_name").alias("task"))
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 7).alias("task_index"))
    return E.with_task_text(rows, tasks).select("c_custkey", "task")


@query
def first_frame_task(spark, sf):
    return E.first_frame(frames(spark, sf), "ep", "task")


@query
def episode_index_build(spark, sf):
    return frames(spark, sf).groupBy("ep").agg(F.count("*").alias("frames"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.sum("event_id").alias("checksum"))


@query
def frame_labels(spark, sf):
    return frames(spark, sf).select("event_id", "ep")


@query
def natural_sort(spark, sf):
    brands = table(spark, sf, "part").select("p_brand").distinct()
    return brands.select("p_brand", F.row_number().over(Window.orderBy(X.natural_key(F.col("p_brand")))).cast("long").alias("place"))


@query
def parse_episode_id(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("demo"), "o_orderkey")).otherwise(F.concat(F.lit("d/episode_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".parquet"))).alias("path"))
    return rows.select("o_orderkey", X.episode_number(F.col("path"), F.lit(-1).cast("long")).alias("ep"))


@query
def demo_order(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("demo_"), F.col("c_custkey")).alias("name"))
    return names.select("c_custkey", X.trailing_number(F.col("name")).alias("number"), X.trailing_number(F.concat("name", F.lit("x"))).alias("none"))


@query
def make_sample(spark, sf):
    rows = chunked(spark, sf)
    return rows.select("event_id", "ep", F.col("j").cast("long").alias("j"), (F.col("j") / 10.0).alias("seconds"), F.coalesce("task", F.lit("")).alias("prompt"), F.element_at("chunk", 1).alias("first"), F.element_at("chunk", H).alias("last"))


@query
def repack(spark, sf):
    rows = frames(spark, sf).select("event_id", F.struct(F.struct(F.col("v").alias("state")).alias("observation"), F.col("task").alias("prompt")).alias("s"))
    return rows.select("event_id", F.col("s.observation.state").alias("state"), F.col("s.prompt").alias("prompt"))


@query
def action_chunks_clamped(spark, sf):
    return chunked(spark, sf).select("event_id", *(F.element_at("chunk", i + 1).alias(f"c{i}") for i in range(H)))


@query
def valid_start_frames(spark, sf):
    return E.valid_starts(short_frames(spark, sf), 4).select("ep", F.col("j").cast("long").alias("j"))


@query
def frames_of_episodes(spark, sf):
    chosen = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(chosen, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query
def task_filter(spark, sf):
    first = E.first_frame(frames(spark, sf), "ep", "task")
    return first.where(E.matches_task(F.col("task"), contains="C", regex="[kr]$")).select("ep", "task")


@query
def include_index_semijoin(spark, sf):
    listed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ep"), F.col("o_custkey").alias("pos"))
    have = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ep"))
    return C.include_index(listed, have).groupBy("ep").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))


@query
def include_bitmap(spark, sf):
    """Lines of the orders that an index lists, the index being bits."""
    index = C.bitmap_index(table(spark, sf, "orders").where("o_totalprice > 200000"), "o_orderkey")
    return C.in_bitmap(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), index, "l_orderkey")


@query
def unknown_ids_antijoin(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("ep")).join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ep")), "ep", "left_anti")


@query
def prompt_quality(spark, sf):
    p = F.col("text")
    return table(spark, sf, "conversations").groupBy("role").agg(F.count_if(X.is_blank(p)).alias("empty"), F.count("*").alias("n"), F.max(F.length(p)).cast("long").alias("longest"))


@query
def frames_in_listed_order(spark, sf):
    rows = frames(spark, sf)
    listed = rows.select("ep").distinct().withColumn("pos", -F.col("ep"))
    return E.frames_in_order(rows, listed).select("pos", "ep", F.col("j").cast("long").alias("j"), "event_id")


@query
def labelled_frame_subset(spark, sf):
    rows = frames(spark, sf)
    return E.labelled_subset(rows, rows.where("v > 50"), "event_id").select("event_id", "label")


@query
def run_labels(spark, sf):
    return table(spark, sf, "events").select("event_id", X.numbered_label("dim", F.col("event_id")).alias("label"), X.run_stamp(F.col("ts")).alias("stamp"))


# profiles


@query
def norm_stats_frame_limit(spark, sf):
    """Statistics of randomly chosen episodes of two sources, cut after 500 frames as the limit asks."""
    rows = frames(spark, sf).withColumn("source", F.when(F.col("ep") % 5 == 0, "target").otherwise("prior"))
    got = P.moments(P.sampled_frames(rows, 10, 42, 500).withColumn("x", F.col("v")))
    return got.select("rows", r6("mean"), r6("std"), "lo", "hi")


@query
def norm_stats_meanstd(spark, sf):
    rows = frames(spark, sf).withColumn("w", E.chunk_weight(H)).where(F.col("n") >= H)
    got = P.moments(rows.withColumn("x", F.col("v")), weight="w")
    return got.select(F.col("rows").cast("long").alias("rows"), r6("mean"), r6("std"), "lo", "hi")


def gappy(spark, sf) -> DataFrame:
    """Frames of which every seventh has no value."""
    return frames(spark, sf).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("v")))


@query
def norm_stats_carried(spark, sf):
    """Statistics from three additions, each of which reads new files alone."""
    folder = scratch_folder(spark, "carried")
    profile = K.CarriedProfile(spark, f"{folder}/profile", ("task",))
    for part in range(3):
        gappy(spark, sf).where(F.col("event_id") % 3 == part).select("task", F.col("v").alias("x")).write.mode("append").parquet(f"{folder}/data")
        profile.add(spark.read.parquet(f"{folder}/data"))
    return K.statistics(profile.compact(), "task").select("task", "p", "rows", r6("mean"), r6("std"), "lo", "hi", "quantile")


@query
def norm_stats_with_nulls(spark, sf):
    values = gappy(spark, sf).select("task", F.col("v").alias("x"))
    quantiles = P.histogram_quantiles(values, "task").groupBy("task").agg(F.min_by("quantile", "p").alias("q01"), F.max_by("quantile", "p").alias("q99"))
    return P.moments(values, "task").join(quantiles, "task").select("task", "rows", r6("mean"), r6("std"), "lo", "hi", r6("q01"), r6("q99"))


@query
def action_chunks_with_nulls(spark, sf):
    return E.chunks(gappy(spark, sf), "v", H).select("event_id", *(F.element_at("chunk", i + 1).alias(f"c{i}") for i in range(H)))


@query
def norm_stats_per_task(spark, sf):
    return P.moments(frames(spark, sf).withColumn("x", F.col("v")), "task").select("task", "rows", r6("mean"), r6("std"), "lo", "hi")


@query
def norm_stats_hist_quantiles(spark, sf):
    rows = frames(spark, sf).withColumn("w", E.chunk_weight(H)).where(F.col("n") >= H).withColumn("x", F.col("v"))
    return P.histogram_quantiles(rows, weight="w").select("p", r6("quantile"))


@query
def norm_stats_exact_quantiles(spark, sf):
    return P.exact_quantiles(frames(spark, sf).withColumn("x", F.col("v")), "task").select("task", "p", r6("quantile"))


@query
def norm_stats_all_frames(spark, sf):
    """Statistics of every component over all frames, delta actions first."""
    rows = frames(spark, sf).withColumn("a", V.delta(F.array("v", "k"), F.array("k"), MASK))
    return P.moments(P.component_rows(rows, "a"), "dim").select(F.col("dim").cast("long").alias("dim"), "rows", r6("mean"), r6("std"), "lo", "hi")


# vectors


def two(name: str):
    return [F.round(F.get(name, F.lit(i)), 6).alias(f"{name}{i}") for i in range(2)]


@query
def normalize_zscore(spark, sf):
    return with_stats(spark, sf).withColumn("z", V.standardise(F.col("a"), F.col("mean"), F.col("std"))).select("event_id", *two("z"))


@query
def normalize_quantile(spark, sf):
    return with_stats(spark, sf, True).withColumn("z", V.rescale_quantiles(F.col("a"), F.col("q01"), F.col("q99"))).select("event_id", *two("z"))


@query
def normalize_masked(spark, sf):
    return with_stats(spark, sf).withColumn("z", V.standardise(F.col("a"), F.col("mean"), F.col("std"), MASK)).select("event_id", *two("z"))


@query
def normalize_masked_tail(spark, sf):
    """What lies beyond the mask stays as it is."""
    return with_stats(spark, sf).withColumn("z", V.standardise(F.col("a"), F.col("mean"), F.col("std"), [True], tail=False)).select("event_id", *two("z"))


@query
def mask_padding(spark, sf):
    """The first components of every vector under a mask that was padded (9) or cut (4)."""
    masks = [V.pad_mask(V.bool_mask(6, -1), width) for width in (9, 4)]
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = rows.select("vec_id", "x", F.posexplode(F.array(*map(V.constants, masks))).alias("mask", "flags"))
    kept = F.aggregate(F.zip_with(F.slice("x", F.lit(1), F.size("flags")), "flags", lambda x, f: F.when(f, x).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    flagged = F.size(F.filter("flags", lambda f: f)).cast("long")
    return rows.select("vec_id", F.col("mask").cast("long").alias("mask"), F.size("flags").cast("long").alias("dim"), flagged.alias("flagged"), F.round(kept, 5).alias("kept"))


@query
def denormalize_roundtrip(spark, sf):
    z = V.standardise(F.col("a"), F.col("mean"), F.col("std"), MASK)
    back = with_stats(spark, sf).withColumn("z", z).withColumn("b", V.destandardise(F.col("z"), F.col("mean"), F.col("std"), 2, MASK))
    worst = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return back.agg((F.max(worst) < 1e-9).alias("close"), F.count("*").alias("rows"))


@query
def delta_actions(spark, sf):
    return frames(spark, sf).withColumn("z", V.delta(F.array("v", "k"), F.array(F.lit(1.5), F.lit(2.5)), MASK)).select("event_id", *two("z"))


@query
def pad_vectors(spark, sf):
    rows = frames(spark, sf).select("event_id", V.pad(F.array("v", "k"), 4).alias("p"), V.pad(F.array("v", "k"), 1, truncate=True).alias("t"))
    return rows.select("event_id", F.size("p").cast("long").alias("width"), F.get("p", F.lit(1)).alias("p1"), F.get("p", F.lit(3)).alias("p3"), F.size("t").cast("long").alias("cut"))


@query
def gripper_map(spark, sf):
    unit = V.gripper_to_unit(F.array("v", "k"))
    rows = frames(spark, sf).select("event_id", unit.alias("g"), V.gripper_from_unit(unit, 2).alias("back"))
    return rows.select("event_id", F.get("g", F.lit(0)).alias("kept"), F.get("g", F.lit(1)).alias("unit"), F.get("back", F.lit(1)).alias("back"))


@query
def state_assembly(spark, sf):
    s = V.state_vector(F.array("v", "k"), F.array("k"), F.array("v", "k"))
    return frames(spark, sf).select("event_id", F.size(s).cast("long").alias("width"), F.get(s, F.lit(3)).alias("zero"), F.get(s, F.lit(4)).alias("grip"))


@query
def state_assembly_whole_gripper(spark, sf):
    s = V.state_vector(F.array("v", "k"), F.array("k"), F.array("v", "k"), whole_gripper=True)
    return frames(spark, sf).select("event_id", F.size(s).cast("long").alias("width"), F.get(s, F.lit(3)).alias("g0"), F.get(s, F.lit(4)).alias("g1"))


@query
def quat_to_axisangle(spark, sf):
    q = table(spark, sf, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyzw")))
    unit = q.withColumn("w", F.when(F.col("vec_id") % 10 == 0, 1.0).otherwise(F.col("w")))
    r = unit.withColumn("r", V.axis_angle(*map(F.col, "xyzw")))
    return r.select("vec_id", *(F.round(F.get("r", F.lit(i)), 6).alias(f"r{i}") for i in range(3)))


@query
def flow_interpolation(spark, sf):
    rows = frames(spark, sf).withColumn("e", F.array(uniform(7, "event_id")))
    x, u = V.interpolate(F.col("e"), F.array("v"), F.lit(0.25)), V.flow_target(F.col("e"), F.array("v"))
    return rows.select("event_id", F.round(F.get(x, F.lit(0)), 6).alias("x"), F.round(F.get(u, F.lit(0)), 6).alias("u"))


@query
def sinusoidal_embedding(spark, sf):
    s = V.sinusoidal(F.col("event_id") / 1000.0, 8, 0.004, 4.0)
    return frames(spark, sf).select("event_id", *(F.round(F.get(s, F.lit(i)), 5).alias(f"s{i}") for i in (0, 3, 4, 7)))


@query
def unit_pixels(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") * 36 % 256).cast("double").alias("p")).agg(F.count("*").alias("n")).select("p", F.round(V.unit_pixels(F.col("p")), 9).alias("u"), "n")


@query
def discretize_state(spark, sf):
    return frames(spark, sf).select("event_id", X.discretise(F.col("v") / 250 - 1).alias("level"), X.discretise(F.col("k") / 50 - 1).alias("other"))


@query
def lr_schedule(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("step")).select("step", F.round(V.learning_rate(F.col("step"), decay=8000) * 1e6, 9).alias("rate"))


@query
def adam_momenta(spark, sf):
    b1, b2 = V.adam_momentum(F.col("event_id"))
    return table(spark, sf, "events").select(F.col("event_id").alias("step"), F.round(b1, 9).alias("b1"), F.round(b2, 9).alias("b2"))


# strings


@query
def clean_prompt(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.clean_prompt(F.concat(F.lit(" \n"), F.translate("p_name", " ", "_"), F.lit("\t "))).alias("prompt"))


@query
def task_to_prompt(spark, sf):
    name = F.concat(F.lit("K_SCENE"), F.col("p_size") % 12, F.lit("_"), F.translate("p_name", " ", "_"), F.lit("_demo.hdf5"))
    return table(spark, sf, "part").select("p_partkey", X.name_to_prompt(name, True).alias("short"), X.name_to_prompt(name, False).alias("whole"))


@query
def state_prompt(spark, sf):
    return frames(spark, sf).select("event_id", X.state_prompt(F.col("task"), F.array(F.col("v") / 250 - 1, F.col("k") / 50 - 1)).alias("prompt"))


@query
def file_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slug(F.concat("url", F.lit(" x"))).alias("slug"))


@query
def tokenize_pad(spark, sf):
    """Whitespace tokens, cut or padded to 6, with a mask; a piece model's tokens take the same shape."""
    words = F.split(X.clean_prompt(F.col("p_name")), r"\s+")
    rows = table(spark, sf, "part").select("p_partkey", F.slice(words, 1, 6).alias("w"))
    return rows.select("p_partkey", F.array_join(F.concat("w", F.array_repeat(F.lit("0"), 6 - F.size("w"))), " ").alias("tokens"), F.size("w").cast("long").alias("real"))


# samples


@query
def stratified_sample(spark, sf):
    return S.stratified(E.first_frame(frames(spark, sf), "ep", "task"), "task", "ep", 5, 42).select("task", "ep")


@query
def candidate_sample(spark, sf):
    eps = table(spark, sf, "events").select(F.col("user_id").alias("ep")).distinct()
    return S.prefix_sample(eps, "ep", S.share_size(eps.count(), 0.25), 42)


@query
def prefix_stable_sample(spark, sf):
    return S.prefix_sample(E.valid_starts(frames(spark, sf), H), "event_id", 200, 7).select("event_id", "ep")


@query
def mixture_sample(spark, sf):
    sizes = [table(spark, sf, t).count() for t in ("orders", "customer")]
    return S.mixture(spark, sizes, [0.7, 0.3], 2000, 42).select("i", F.col("source").cast("long").alias("source"), "row")


def weighted_customers(spark, sf) -> DataFrame:
    """A source per customer, weighted by what was ordered, with a row per order."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("weight"), F.count("*").alias("size"))


@query
def alias_probabilities(spark, sf):
    """How likely every source is, by the cells of its alias table."""
    got = A.probabilities(A.alias_table(weighted_customers(spark, sf), cells=128))
    return got.select("source", r6("probability", 9))


@query
def alias_draws(spark, sf):
    """As many draws as there are line items: whether each names an order of its customer, and that none is lost."""
    sources = weighted_customers(spark, sf)
    drawn = A.alias_mixture(A.alias_table(sources), table(spark, sf, "lineitem").count(), 42)
    joined = drawn.join(sources, "source")
    return joined.agg(F.count("*").alias("draws"), F.count_distinct("i").alias("numbers"), F.count_if((F.col("row") >= 0) & (F.col("row") < F.col("size"))).alias("of_their_source"))


@query
def episode_chunk_sample(spark, sf):
    return S.bootstrap_chunks(E.valid_starts(frames(spark, sf), H), 42).select("i", "ep", "j")


@query
def coverage_first_sample(spark, sf):
    return S.coverage_first(E.valid_starts(frames(spark, sf), H), 400, 42).select("i", "ep", "j")


@query
def cotrain_sample(spark, sf):
    """Half from source episodes, half from target episodes: a mixture of two bootstraps."""
    starts = E.valid_starts(frames(spark, sf), H)
    parts = [S.bootstrap_chunks(starts.where(f"ep % 5 {op} 0"), seed).select(F.lit(k).alias("source"), F.col("i").alias("row"), "ep", "j") for k, (op, seed) in enumerate((("<>", 42), ("=", 43)))]
    pool = parts[0].unionByName(parts[1])
    return S.mixture(spark, [p.count() for p in parts], [0.5, 0.5], 3000, 42).join(pool, ["source", "row"]).select("i", F.col("source").cast("long").alias("source"), "ep", "j")


@query
def frame_mixture_labelled(spark, sf):
    rows = frames(spark, sf)
    got = S.frame_mixture([rows.where("ep % 5 <> 0"), rows.where("ep % 5 = 0")], [0.7, 0.3], 2000, 42, "event_id", labelled=0)
    return got.select("i", F.col("source").cast("long").alias("source"), "event_id", "label")


@query
def first_episodes(spark, sf):
    return S.episode_subset(table(spark, sf, "events").select(F.col("user_id").alias("ep")).distinct(), "ep", 10)


@query
def limited_passes(spark, sf):
    return S.passes(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 16, 2, seed=11, most=3).select("pass", "o_orderkey", "batch", "place")


@query
def batch_assign_drop_last(spark, sf):
    got = S.batches(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 64, 11)
    return got.select("o_orderkey", "batch", "place")


@query
def batch_at_modulo(spark, sf):
    """Batches of 64 orders, a third of a pass beyond the table's end."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    n = orders.count()
    rows = S.numbered(orders, "o_orderkey", E.id_part(orders, "o_orderkey"), "row")
    return S.modulo_batches(spark, n, 64, n * 4 // 3 // 64).join(rows, "row").select("batch", "place", "o_orderkey")


@query
def shuffled_batches(spark, sf):
    """Two shuffled passes over the events, each row's place computed from its number."""
    rows = table(spark, sf, "events").select("event_id")
    return S.computed_batches(rows, "event_id", rows.count(), 64, seed=11, turns=2).select("pass", "batch", "place", "event_id")


@query
def draws_beyond_the_pool(spark, sf):
    """Frame numbers drawn without replacement until the pool is empty, then again."""
    n = table(spark, sf, "events").count()
    rows = table(spark, sf, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("ep"))
    return S.draws_in_passes(spark, n, n * 5 // 2, seed=19).join(rows, "i").select("draw", "i", "ep")


@query
def frame_noise(spark, sf):
    return frames(spark, sf).select("event_id", F.round(normal(5, "event_id"), 5).alias("noise"))


@query
def task_counts(spark, sf):
    return E.first_frame(frames(spark, sf), "ep", "task").groupBy("task").agg(F.count("*").alias("n"))


@query
def sampled_task_summary(spark, sf):
    got = S.prefix_sample(frames(spark, sf), "event_id", 500, 3).withColumn("prompt", X.clean_prompt(F.concat("task", F.lit("_go"))))
    return Q.task_summary(got, "task", "prompt")


# scores and selection


@query
def mean_nonzero_scores(spark, sf):
    return mean_scores(spark, sf).select("ep", r6("score"))


@query
def select_bottom_k(spark, sf):
    means = mean_scores(spark, sf).withColumn("rounded", F.round("score", 9))
    n = table(spark, sf, "events").select("user_id").distinct().count()
    return C.bottom_k(means, 0.1, n, score="rounded").select("ep", r6("score"))


@query
def select_percentile(spark, sf):
    one = mean_scores(spark, sf).select("ep", F.round("score", 9).alias("score"))
    return C.percentile_select(one, one.where("ep % 2 = 0").select("ep"))


@query
def scores_dense(spark, sf):
    one = mean_scores(spark, sf)
    top = one.agg(F.max("ep")).first()[0]
    return C.dense(one, (top or 0) + 1).select("ep", r6("score"))


@query
def score_summary(spark, sf):
    got = C.score_summary(scores(spark, sf))
    return got.select("scored", "nonzero", r6("least"), r6("most"), r6("mean"), "all_zero")


@query
def iteration_order(spark, sf):
    names = table(spark, sf, "region").select(F.concat(F.lit("iter_"), F.col("r_regionkey") * 7 % 12).alias("name"))
    return C.iteration_order(names).select("name", F.col("turn").cast("long").alias("turn"))


@query
def episode_weighted_loss(spark, sf):
    rows = frames(spark, sf).withColumn("loss", F.col("v") / 100)
    w = C.episode_weight(F.when(F.col("ep") % 11 == 0, -1).otherwise(F.col("ep")), F.col("ep") % 2 == 0, F.col("ep") % 3 == 0, F.lit(1.0), F.lit(0.25), True)
    return C.weighted_loss(rows.withColumn("weight", w)).select(r6("loss"), "rows")


@query
def loss_of_batches(spark, sf):
    means = frames(spark, sf).groupBy(F.floor(F.col("event_id") / 32)).agg(F.avg("v").alias("mean"), F.count("*").alias("rows"))
    return C.batch_weighted_loss(means).select(r6("loss"), "rows")


@query
def validation_loss(spark, sf):
    return Q.validation_loss(frames(spark, sf), "v").select(r6("loss"), "rows")


@query
def loss_breakdown(spark, sf):
    rows = frames(spark, sf).withColumn("d", F.col("j") % 9).withColumn("e", F.col("v"))
    got = Q.loss_breakdown(rows, 8)
    return got.select(*(r6(c) for c in got.columns))


# errors and reports


def errors(spark, sf) -> DataFrame:
    """Chunks of two components against the prediction that the first action repeats."""
    both = E.chunks(frames(spark, sf).withColumn("a", F.array("v", "k")), "a", H, out="actual")
    both = both.withColumn("predicted", F.array_repeat(F.element_at("actual", 1), H))
    return Q.chunk_errors(both, "predicted", "actual", "ep")


@query
def chunk_mse_grouping_sets(spark, sf):
    return Q.error_cube(errors(spark, sf)).select(F.col("h").cast("long").alias("h"), F.col("d").cast("long").alias("d"), F.round("mse", 4).alias("mse"))


@query
def chunk_mse_groups(spark, sf):
    got = Q.group_errors(errors(spark, sf), (("first", 0, 1), ("rest", 1, 7)), 2)
    return got.select("name", F.col("h").cast("long").alias("h"), F.round("mse", 4).alias("mse"))


@query
def best_horizon(spark, sf):
    by = errors(spark, sf).where("h > 0").groupBy("d", "h").agg(F.round(F.avg("e"), 4).alias("mse"))
    return Q.best_step(by, "d").select(F.col("d").cast("long").alias("d"), F.col("best").cast("long").alias("best"), "mse")


@query
def success_rate_running(spark, sf):
    got = Q.success_rates(frames(spark, sf).withColumn("success", F.col("v") > 50))
    return got.withColumn("rate", F.round("rate", 9))


@query
def episode_status(spark, sf):
    rows = frames(spark, sf).select(Q.status(F.col("v") > 50, F.when(F.col("task") == "error", F.col("task"))).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query
def metric_count_windows(spark, sf):
    got = Q.metric_windows(table(spark, sf, "events").select(F.col("event_id").alias("step"), "value"), 50)
    return got.select("window", r6("mean"), "instant", "logged", "rows")


@query
def numeric_means(spark, sf):
    got = Q.numeric_means(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_returnflag"))
    return got.select(*(r6(c) for c in got.columns))


def damaged(spark, sf) -> DataFrame:
    return frames(spark, sf).withColumn("bad", F.col("task") == "error")


@query
def quality_scan(spark, sf):
    return D.damage_report(damaged(spark, sf))


@query
def quality_scan_first_failure(spark, sf):
    return D.damage_report(damaged(spark, sf), stop_early=True)


def big_endian(n):
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def png_chunk(name: str, data, spoil: int = 0):
    body = F.concat(F.encode(F.lit(name), "UTF-8"), data)
    return F.concat(big_endian(F.octet_length(data)), body, big_endian((F.crc32(body) + spoil) % 4294967296))


def pictures(spark, sf) -> DataFrame:
    """doc_id, ep, and two cameras: PNG and JPEG files around the documents' texts, some of them cut, spoilt, missing or something else."""
    text, i = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.col("doc_id")
    head = F.unhex(F.lit("89504E470D0A1A0A"))
    size = png_chunk("IHDR", F.concat(big_endian(F.octet_length(text)), F.unhex(F.lit("000000010800000000"))))
    end = png_chunk("IEND", F.unhex(F.lit("")))
    png = F.concat(head, size, png_chunk("IDAT", text), end)
    front = F.when(i % 7 == 0, F.substring(png, F.lit(1), F.octet_length(png) - 5)).when(i % 7 == 1, F.concat(head, size, png_chunk("IDAT", text, 1), end)).when(i % 7 == 2, F.lit(None)).when(i % 7 == 3, F.concat(F.encode(F.lit("no picture: "), "UTF-8"), text)).otherwise(png)
    start, stop = F.unhex(F.lit("FFD8FFC00011080010002003012200021101031101FFDA000C03010002110311003F00")), F.unhex(F.lit("FFD9"))
    side = F.when(i % 5 == 0, F.concat(start, text)).when(i % 5 == 1, F.concat(start, text, F.unhex(F.lit("FF05")), stop)).otherwise(F.concat(start, text, stop))
    return table(spark, sf, "documents").select("doc_id", (i % 50).alias("ep"), front.alias("front"), side.alias("side"))


@query
def picture_damage(spark, sf):
    """States of pictures by camera."""
    rows = pictures(spark, sf).select("ep", picture_state(F.col("front"))["state"].alias("front"), picture_state(F.col("side"))["state"].alias("side"))
    return D.damage_by_column(rows, {c: F.col(c) for c in ("front", "side")}).withColumnRenamed("column", "camera")


@query
def picture_sizes(spark, sf):
    """Kind, state and size of every document's pictures."""
    rows = pictures(spark, sf).select("doc_id", picture_state(F.col("front")).alias("f"), picture_state(F.col("side")).alias("s"))
    return rows.select("doc_id", F.col("f.kind").alias("front"), F.col("f.state").alias("front_state"), F.col("f.width").cast("long").alias("front_width"), F.col("s.kind").alias("side"), F.col("s.state").alias("side_state"), F.col("s.width").cast("long").alias("side_width"))


@query
def repair_nearest(spark, sf):
    return D.nearest_valid(damaged(spark, sf)).select("ep", F.col("j").cast("long").alias("j"), F.col("source").cast("long").alias("source"), "v")


def dataset(spark, sf) -> str:
    """A dataset of the events, a file per episode; returns its root."""
    root = f"{scratch_folder(spark, 'dataset')}/set"
    rows = damaged(spark, sf).select("ep", "j", F.when(F.col("task") != "view", F.col("task")).alias("task"), "event_id", "v", (F.col("bad") & (F.col("ep") % 10 == 0)).alias("bad"))
    write_dataset(rows, root, fps=10)
    return root


@query
def dataset_round_trip(spark, sf):
    """Every frame as the written dataset has it, with the file it is in."""
    rows = FileTable(spark, dataset(spark, sf))
    rows.adopt()
    got = rows.read(places=True)
    return got.select(F.col("__file").alias("file"), F.col("__row").alias("row"), "event_id", "v", "episode_index", "frame_index", "index", "task_index", F.round(F.col("timestamp").cast("double"), 3).alias("seconds"))


@query
def file_footers(spark, sf):
    """What the footers of every episode's file say of its columns, and which column stands for a logical one."""
    root = dataset(spark, sf)
    stored = FileTable(spark, root)
    stored.adopt()
    found = footers(stored.files().select(F.concat(F.lit(f"{root}/"), "path").alias("path")))
    wanted = missing_columns(found, {"action": ["action", "v"], "state": ["state", "observation.state"]}).groupBy("path").agg(F.max(F.when(F.col("logical") == "action", F.col("column"))).alias("action"), F.count_if(F.col("column").isNull()).alias("missing"))
    nulls = found.groupBy("path").agg(F.max("rows").alias("rows"), F.count("*").alias("columns"), F.max(F.when(F.col("column") == "task_index", F.col("nulls"))).alias("tasks_missing"))
    return nulls.join(wanted, "path").select(F.regexp_extract("path", r"(\d+)\.parquet$", 1).cast("long").alias("ep"), "rows", "columns", "tasks_missing", "action", "missing")


@query
def frames_by_number(spark, sf):
    """Frames by their numbers among all, from the files that hold them."""
    stored = FileTable(spark, dataset(spark, sf))
    stored.adopt()
    numbers = table(spark, sf, "events").where("event_id % 97 = 0").select(F.col("event_id").alias("i"))
    return stored.rows_at(numbers).select("i", "event_id", "episode_index", "frame_index")


@query
def repair_touched_files(spark, sf):
    """Frames after a repair that writes only files with damaged frames, and whether their file is one of these."""
    stored = FileTable(spark, dataset(spark, sf))
    stored.adopt()
    repair_files(stored, F.col("bad"), ["v"])
    return stored.read(places=True).select("event_id", "episode_index", "frame_index", "v", F.col("__file").startswith("_changes/").alias("rewritten"))


@query
def score_vectors(spark, sf):
    """Scores of all iterations through their .npy files: dense vectors of even iterations, pairs of odd ones."""
    folder, rows = scratch_folder(spark, "scores"), scores(spark, sf)
    n = rows.agg(F.max("ep")).first()[0] + 1
    for turn in range(5):
        own, at = rows.where(F.col("iter") == turn), f"{folder}/iter_{turn}"
        if turn % 2:
            sinks.save_score_arrays(own, at, n)
        else:
            write_npy(own, f"{at}/{files.DENSE}", "ep", "score", n)
    return files.load_scores(spark, [f"{folder}/iter_{turn}" for turn in range(5)]).select("ep", F.col("iter").cast("long").alias("iter"), r6("score"))


@query
def report_episodes(spark, sf):
    """Reports list 1,000 ids of episodes each, at most."""
    bad = damaged(spark, sf).where("bad").select("ep").distinct().groupBy(F.floor(F.col("ep") / 1000).alias("thousand"))
    bad = bad.agg(F.array(F.struct(F.lit("r").alias("root"), F.collect_list("ep").alias("bad_episode_indices"))).alias("reports"))
    return D.bad_episodes(bad, "r")


# influence


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("ep"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))


THETA = [0.05 * (d % 3) for d in range(64)]


@query
def influence_one_step(spark, sf):
    rows = vectors(spark, sf)
    got = I.one_step_scores(rows.where("vec_id % 10 <> 0"), rows.where("vec_id % 10 = 0"), THETA)
    return got.select("ep", F.round("score", 9).alias("score"))


@query
def influence_replay(spark, sf):
    rows = vectors(spark, sf)
    training = rows.where("vec_id % 10 <> 0").withColumn("batch", F.floor(F.col("vec_id") / 25) % 8)
    return I.replay_scores(training, rows.where("vec_id % 10 <> 0"), rows.where("vec_id % 10 = 0"), THETA, 20, 8, I.Optimiser(rate=1e-3, eps_root=1e-4))


def binary(spark, sf) -> DataFrame:
    return vectors(spark, sf).withColumn("y", F.col("y") % 2)


@query
def influence_logistic(spark, sf):
    """Scores under the logistic loss, whose sums have no closed form."""
    rows = binary(spark, sf)
    got = G.one_step_scores(rows.where("vec_id % 10 <> 0"), rows.where("vec_id % 10 = 0"), THETA, G.LOGISTIC)
    return got.select("ep", F.round("score", 9).alias("score"))


@query
def curvature_product(spark, sf):
    """Per dimension: gradient of the mean logistic loss, and its Hessian times a direction."""
    rows, direction = binary(spark, sf), [(-1.0) ** d / (d + 1) for d in range(64)]
    both = zip(G.mean_sum(rows, THETA, G.LOGISTIC), G.mean_sum(rows, THETA, G.LOGISTIC, direction), strict=True)
    got = spark.createDataFrame([(d, float(g), float(h)) for d, (g, h) in enumerate(both)], "d long, gradient double, product double")
    return got.select("d", r6("gradient", 9), r6("product", 9))


@query
def save_points(spark, sf):
    """Every episode as a replay of as many steps as it has frames, saved every 25 steps and at its end."""
    sizes = frames(spark, sf).groupBy("ep").agg(F.count("*").alias("n"))
    return sizes.select("ep", F.posexplode(I.save_point_steps(F.col("n"), 25)).alias("i", "step")).select("ep", F.col("i").cast("long").alias("i"), "step")


@query
def trajectory_layout(spark, sf):
    """Every episode as a trajectory that backs off 8 steps: which batch each of its steps uses."""
    total, before, after = I.trajectory_columns(F.col("n"), 8)
    rows = frames(spark, sf).select("ep", F.col("j").cast("long").alias("step"), total.alias("total"), before.alias("before"), after.alias("after"))
    return rows.select("ep", "step", I.regular_batch(F.col("step"), F.col("before")).alias("batch"), "total", "before", "after")


@query
def attention_mask(spark, sf):
    """How many positions each position may see."""
    return E.visible_positions(short_frames(spark, sf).withColumn("starts", F.col("role") == "user").withColumn("valid", F.lit(True)))


@query
def split_summary(spark, sf):
    """A full source split beside a stratified target split, counted by task."""
    first = E.first_frame(frames(spark, sf), "ep", "task")
    target = S.stratified(first.where("ep % 5 = 0"), "task", "ep", 3, 42).withColumn("split", F.lit("target"))
    both = first.where("ep % 5 <> 0").withColumn("split", F.lit("source")).unionByName(target)
    return both.groupBy("split", "task").agg(F.count("*").alias("episodes"))


# streams


@query
def stream_moments(spark, sf):
    events = R.read_events(spark, f"{sf}/events*.parquet")
    got = R.run_once(R.running_moments(events, "event_type"), scratch_folder(spark, "moments"), "complete")
    return got.select("event_type", "rows", r6("mean"), r6("std"), "lo", "hi")


@query
def stream_tumbling(spark, sf):
    events = R.read_events(spark, f"{sf}/events*.parquet")
    got = R.run_once(R.tumbling_counts(events, "1 day", "1 hour", "event_type"), scratch_folder(spark, "tumbling"), "complete")
    return got.select(F.unix_timestamp("start").alias("begins"), F.unix_timestamp("end").alias("ends"), "event_type", "rows")


@query
def stream_sessions(spark, sf):
    got = R.run_once(R.session_counts(R.read_events(spark, f"{sf}/events*.parquet"), "user_id"), scratch_folder(spark, "sessions"), "complete")
    return got.select(F.unix_micros("start").alias("begins"), F.unix_micros("end").alias("ends"), "user_id", "rows")


@query
def stream_distinct(spark, sf):
    got = R.run_once(R.distinct_events(R.read_events(spark, f"{sf}/events*.parquet"), "event_id").select("event_id", "user_id"), scratch_folder(spark, "distinct"))
    return got


@query
def stream_count_windows(spark, sf):
    events = R.read_events(spark, f"{sf}/events*.parquet")
    got = R.count_windows(events, scratch_folder(spark, "counts"), 50, "event_type", order=("ts", "event_id"), unfinished=True)
    return got.select("key", "window", "rows", r6("mean"))


@query
def stream_metric_log(spark, sf):
    """Every event once, from the log that two runs of one stream appended to."""
    events = R.read_events(spark, f"{sf}/events*.parquet").select("event_id", "event_type", "value")
    folder = scratch_folder(spark, "metrics")
    for _ in range(2):
        log_metrics(events, f"{folder}/log", f"{folder}/checkpoint", once=True).awaitTermination()
    return read_metrics(spark, f"{folder}/log", events.schema)
