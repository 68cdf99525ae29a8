"""Scores of texts from models, as one table: status, calibrated probabilities, groups, stressor tags behind a gate.

A model is a Part: how a text is taken to pieces, a function that adds raw scores to a table of pieces, what calibrates them, and
how pieces become the text's score. Everything around the model is DataFrame operations, so a model may be columns, an Arrow
function (`by_scorer`) or a join with saved scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as T
from tidewell.operators import ingest, scoring
from tidewell.operators.sampling import two_stage

SCORED = ("ok", "ok_truncated")


def tempered(temperature: float) -> Callable[[str, Column], Column]:
    """A logit to a probability by one temperature."""
    return lambda _, z: scoring.sigmoid(z, temperature)


def platt(params: dict[str, tuple[float, float]]) -> Callable[[str, Column], Column]:
    """A logit of each label to a probability by its own a and b."""
    return lambda name, z: 1 / (1 + F.exp(-(F.lit(params[name][0]) * z + F.lit(params[name][1]))))


@dataclass
class Part:
    """One model: names of its scores, pieces of a text, raw scores of pieces, calibration, and how pieces count together."""

    names: tuple[str, ...]
    pieces: Callable[[Column], Column]
    score: Callable[[DataFrame], DataFrame]
    calibrate: Callable[[str, Column], Column] = field(default=lambda _, z: z)
    together: str = "mean"
    version: str | None = None


def by_scorer(scorer: scoring.Scorer) -> Callable[[DataFrame], DataFrame]:
    """Raw scores of a table of pieces by a model that runs in Python."""
    return lambda pieces: scoring.run_scorer(pieces, "piece", scorer, "")


def part_scores(df: DataFrame, key: str, text: str, part: Part, prefix: str) -> DataFrame:
    """key, n_pieces and prefix<name> for each score of a part. Texts without pieces, or with an unknown score in one, have null scores."""
    pieces = df.select(key, F.posexplode(part.pieces(F.col(text))).alias("place", "piece"))
    scored = part.score(pieces).select(key, *(part.calibrate(n, F.col(n).cast("double")).alias(n) for n in part.names))
    known = {n: F.count(F.nanvl(F.col(n), F.lit(None).cast("double"))) == F.count("*") for n in part.names}
    how = {"mean": F.avg, "max": F.max, "sum": F.sum}
    if part.together in how:
        return scored.groupBy(key).agg(F.count("*").cast("int").alias("n_pieces"), *(F.when(known[n], how[part.together](n)).alias(prefix + n) for n in part.names))
    if part.together != "top2_mean":
        raise ValueError(f"no way {part.together!r} to take pieces together")
    out = {n: F.when(known[n], F.aggregate(F.slice(F.sort_array(F.collect_list(n), False), 1, 2), F.lit(0.0), lambda a, x: a + x) / F.least(F.count("*"), F.lit(2))) for n in part.names}
    return scored.groupBy(key).agg(F.count("*").cast("int").alias("n_pieces"), *(c.alias(prefix + n) for n, c in out.items()))


def groups_of(members: dict[str, list[str]], prefix: str, combine: str = "max") -> dict[str, Column]:
    """Probabilities of groups from those of their labels: the greatest, or 1 - prod(1 - p)."""
    of = {"max": scoring.group_max, "noisy_or": scoring.noisy_or}[combine]
    return {g: of([prefix + m for m in own]) for g, own in members.items()}


def hybrid_scores(classes: DataFrame, mapping: DataFrame, cosine: DataFrame, key: str) -> DataFrame:
    """(key, category, p, kind): class probabilities (key, class, p) summed to categories; categories of the map (class, category) without a class are scored by cosine (key, category, p) and are null where it has none."""
    supervised = scoring.merge_classes(classes, mapping.where("class is not null"), key).withColumn("kind", F.lit("probability"))
    other = mapping.where("class is null").select("category").distinct()
    keys = classes.select(key).distinct()
    zero = keys.withColumn("category", F.explode(F.array(*(F.lit(r.category) for r in other.collect())))) if other.limit(1).count() else keys.withColumn("category", F.lit("")).limit(0)  # a row for each category
    filled = zero.join(cosine.select(key, "category", "p"), [key, "category"], "left").withColumn("kind", F.lit("cosine"))
    return supervised.select(key, "category", "p", "kind").unionByName(filled.select(key, "category", "p", "kind"))


def tagged(df: DataFrame, thresholds: dict[str, float], prefix: str, gate: str | None = None) -> DataFrame:
    """df with stressor_flag__<c>, stressor_top and stressor_none_unclear from prefix<c>. top is the flagged category with the greatest margin (ties by order), none_unclear if none is. With a gate, texts that it does not flag carry no tags, though their raw scores stay. All are null where a score is unknown."""
    known = F.lit(True)
    for c in thresholds:
        known = known & F.col(prefix + c).isNotNull()
    opened = F.coalesce(F.col(gate), F.lit(False)) if gate else F.lit(True)
    flag = {c: opened & (F.col(prefix + c) >= t) for c, t in thresholds.items()}
    margins = F.array(*(F.when(flag[c], F.struct(F.round(F.col(prefix + c) - t, 12).alias("m"), F.lit(-i).alias("i"), F.lit(c).alias("c"))) for i, (c, t) in enumerate(thresholds.items())))
    top = F.array_max(F.filter(margins, lambda x: x.isNotNull()))["c"]
    any_ = F.lit(False)
    for f in flag.values():
        any_ = any_ | f
    return df.withColumns({**{f"stressor_flag__{c}": F.when(known, f) for c, f in flag.items()}, "stressor_top": F.when(known, F.coalesce(top, F.lit("none_unclear"))), "stressor_none_unclear": F.when(known, ~any_)})


def predict(df: DataFrame, key: str, raw: str, stress: Part, emotion: Part, groups: dict[str, list[str]], threshold: float, stressor: Part | None = None, stressor_thresholds: dict[str, float] | None = None, kinds: dict[str, str] | None = None, lang: str | None = None, gate: bool = True, rate: float | None = None, seed: int = 42, combine: str = "max") -> DataFrame:
    """One row per row of df (key, raw[, lang]; keys are unique).

    Texts that can't be scored have null scores and say why in input_status; one whose pieces could not be scored has error_chunking.
    Every scorable text gets the stress part; the others run on all of them, or, with a rate, on the flagged ones and a hash sample of
    the rest (second_stage_scored, sample_weight). Texts go to a part only once, and only those that it scores.
    """
    if rate is not None and not 0 < rate <= 1:
        raise ValueError(f"the rate must be in (0, 1], not {rate}")
    clean = ingest.clean_input(F.col(raw))
    base = df.select(key, raw, *([lang] if lang else []), clean.alias("clean"))
    base = base.select(key, "clean", ingest.input_status(F.col(raw), F.col("clean"), F.col(lang) if lang else None).alias("input_status"))
    ok = base.where(F.col("input_status").isin(*SCORED))
    first = part_scores(ok, key, "clean", stress, "").withColumnRenamed("n_pieces", "n_chunks_stress")
    name = stress.names[0]
    one = base.join(first, key, "left").withColumn("stress_prob", F.col(name)).drop(*stress.names)
    one = one.withColumn("stress_flag", F.col("stress_prob") >= threshold)
    valid = F.col("input_status").isin(*SCORED) & F.col("stress_prob").isNotNull()
    flagged = F.coalesce(F.col("stress_flag"), F.lit(False))
    if rate is None:
        one = one.withColumns({"second_stage_scored": valid, "sample_weight": F.when(valid, 1.0)})
    else:
        one = two_stage(one.withColumn("__flag", flagged), key, "__flag", rate, seed).drop("__flag")
        one = one.withColumns({"second_stage_scored": F.col("second_stage_scored") & valid, "sample_weight": F.when(valid, F.col("sample_weight"))})
    chosen = one.where("second_stage_scored").select(key, "clean")
    out = one.join(part_scores(chosen, key, "clean", emotion, "emotion_p__").withColumnRenamed("n_pieces", "n_chunks_emotion"), key, "left")
    out = out.withColumns({f"emotion_group__{g}": c for g, c in groups_of(groups, "emotion_p__", combine).items()})
    names = [f"emotion_p__{n}" for n in emotion.names]
    failed = F.col("input_status").isin(*SCORED) & (F.col("stress_prob").isNull() | (F.col("second_stage_scored") & F.col(names[0]).isNull()))
    out = out.withColumn("input_status", F.when(failed, "error_chunking").otherwise(F.col("input_status")))
    extra: list[str] = []
    if stressor is not None:
        kinds = kinds or {}
        out = out.join(part_scores(chosen, key, "clean", stressor, "score__").drop("n_pieces"), key, "left")
        out = tagged(out, {c: stressor_thresholds[c] for c in stressor.names}, "score__", "stress_flag" if gate else None)
        out = out.withColumnsRenamed({f"score__{c}": f"stressor_{kinds.get(c, 'p')}__{c}" for c in stressor.names})
        extra = [*(f"stressor_{kinds.get(c, 'p')}__{c}" for c in stressor.names), *(f"stressor_flag__{c}" for c in stressor.names), "stressor_top", "stressor_none_unclear"]
    versions = {"stress_version": stress.version, "emotion_version": emotion.version, "stressor_version": stressor.version if stressor else None}
    chunks = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_chunks_stress", "n_chunks_emotion")}
    out = out.withColumns({**{k: F.lit(v).cast("string") for k, v in versions.items()}, **chunks})
    return out.select(key, "input_status", "stress_prob", "stress_flag", *names, *(f"emotion_group__{g}" for g in groups), *extra, *versions, *chunks, "second_stage_scored", "sample_weight")


def enriched(lake: DataFrame, predicted: DataFrame, key: str = "record_id") -> DataFrame:
    """Lake records without their text, their date and scores, and when that was done."""
    meta = lake.select(key, "created_at", "source", "community", F.to_date("created_at").alias("date"))
    return meta.join(predicted, key).withColumn("inference_ts", F.current_timestamp())


def keyword_flags(hits: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """key and flag__<category>: at least so many windows hit."""
    return hits.select(key, *((F.col(c) >= n).alias(f"flag__{c}") for c, n in counts.items()))


def sentence_pieces(per_window: int = 1, min_words: int = 4, most: int | None = None) -> Callable[[Column], Column]:
    return lambda text: T.sentence_windows(text, per_window, min_words, most)


def chunk_pieces(max_tokens: int, stride: int = 64, most: int | None = None) -> Callable[[Column], Column]:
    """Token-budget chunks of a text."""
    from tidewell.operators.segment import chunk_column

    chunk = chunk_column(max_tokens, stride, most)
    return lambda text: F.transform(chunk(text), lambda c: c["text"])
