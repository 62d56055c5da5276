"""Five signals of manipulation, each a struct(name, triggered, severity, evidence), and the penalty they add up to."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.config import DEFAULT_ANTIGAMING, AntiGamingConfig
from rankweave.functions.text import STOPWORDS, tokens, trigrams
from rankweave.functions.vectors import clamp, cosine
from rankweave.operators.rankers import few
from rankweave.runtime import small_batches
from rankweave.schemas import background_for, rgb

SIGNALS = ("invisible_text", "skill_density", "repetition", "jd_echo", "incoherence")
MIN_PEERS, MIN_TOKENS, MIN_CONTENT, MIN_REPEATS = 8, 50, 120, 8
_HIDDEN_SHARE, _HIDDEN_FULL = 0.005, 0.05


def _signal(name: str, triggered: Column, severity: Column, evidence: Column) -> Column:
    on = F.coalesce(triggered, F.lit(False))
    return F.struct(F.lit(name).alias("name"), on.alias("triggered"), F.when(on, clamp(severity)).otherwise(0.0).alias("severity"), evidence.alias("evidence"))


def rgb_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a.getField(x) - b.getField(x), 2) for x in "rgb"), F.lit(0.0)))


def hidden_share(spans: Column, backgrounds: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    """Characters in the background's colour or too small to read, over all; null without spans."""
    shown = F.filter(spans, lambda s: s.getField("text").rlike(r"\S"))
    near = lambda s: rgb_distance(rgb(s.getField("color")), rgb(background_for(backgrounds, s.getField("page")))) < config.invisible_color_distance
    tiny = lambda s: (s.getField("size") > 0) & (s.getField("size") < config.min_readable_font_size)
    length = lambda over: F.aggregate(over, F.lit(0), lambda n, s: n + F.length(s.getField("text")))
    return F.try_divide(length(F.filter(shown, lambda s: F.coalesce(near(s), F.lit(False)) | F.coalesce(tiny(s), F.lit(False)))).cast("double"), length(shown))


def invisible_text(spans: Column, backgrounds: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    share = hidden_share(spans, backgrounds, config)
    evidence = F.when(share.isNull(), "no spans to look at").when(share >= _HIDDEN_SHARE, F.format_string("%.1f%% of characters can't be seen", share * 100)).otherwise("nothing hidden")
    return _signal("invisible_text", share >= _HIDDEN_SHARE, share / _HIDDEN_FULL, evidence)


def skill_density(skills: Column, text: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(skills).cast("double"), F.size(tokens(text))), F.lit(0.0))


def corpus_stats(rows: DataFrame, density: Column, batch: list[str] | None = None) -> DataFrame:
    """One row a batch: density_mean, density_std (population), sample_size, usable."""
    out = rows.groupBy(*(batch or [])).agg(F.coalesce(F.avg(density), F.lit(0.0)).alias("density_mean"), F.coalesce(F.stddev_pop(density), F.lit(0.0)).alias("density_std"), F.count(density).alias("sample_size"))
    return out.withColumn("usable", (F.col("sample_size") >= MIN_PEERS) & (F.col("density_std") > 1e-9))


def skill_density_signal(skills: Column, text: Column, mean: Column, std: Column, usable: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    density, n = skill_density(skills, text), F.size(tokens(text))
    z = F.try_divide(density - mean, std)
    by_z, limit, fixed = F.coalesce(usable, F.lit(False)), config.density_zscore_threshold, config.density_absolute_threshold
    excess = F.when(by_z, (z - limit) / limit).otherwise((density - fixed) / fixed)
    evidence = F.when(n < MIN_TOKENS, "too short to judge density").otherwise(F.concat_ws(", ", F.format_string("%d skills in %d tokens", F.size(skills), n), F.when(by_z, F.format_string("z=%+.2f", z))))
    return _signal("skill_density", (n >= MIN_TOKENS) & (excess > 0), excess, evidence)


def content_tokens(text: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    stop = F.array(*[F.lit(w) for w in sorted(STOPWORDS)])
    return F.filter(tokens(text), lambda t: (F.length(t) >= config.repetition_min_term_length) & ~F.array_contains(stop, t))


def top_terms(rows: DataFrame, key: str, text: str, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> DataFrame:
    """(key, n_content, term, n): each text's most frequent content word, the first seen of equals; texts without content words are left out.

    Words are counted inside the row, so nothing is shuffled.
    """
    small_batches(rows.sparkSession)
    words = rows.select(F.col(key), content_tokens(F.col(text), config).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, len(w), *Counter(w).most_common(1)[0]) for i, w in enumerate(batch.column(1).to_pylist()) if w]  # equal counts keep the order seen
            at, n, term, times = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [])
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(term, pa.string()), pa.array(times, pa.int64())], names=[key, "n_content", "term", "n"])

    return words.mapInArrow(count, f"`{key}` {dict(words.dtypes)[key]}, n_content long, term string, n long")


def repetition_signal(n_content: Column, term: Column, n: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    rate, limit = F.try_divide(n * F.lit(1000.0), n_content), config.repetition_per_1k_threshold
    enough = F.coalesce(n_content, F.lit(0)) >= MIN_CONTENT
    evidence = F.when(enough, F.format_string("%s occurs %d times, %.1f in a thousand", term, n, rate)).otherwise("too short to judge repetition")
    return _signal("repetition", enough & (rate > limit) & (n >= MIN_REPEATS), (rate - limit) / limit, evidence)


def echo_ratio(text: Column, job_text: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    """Share of the job's trigrams that the text has; null for jobs with too few."""
    theirs = trigrams(tokens(job_text))
    shared = F.size(F.array_intersect(theirs, trigrams(tokens(text))))
    return F.when(F.size(theirs) >= config.jd_echo_min_trigrams, shared.cast("double") / F.size(theirs))


def echo_pairs(texts: DataFrame, jobs: DataFrame, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> DataFrame:
    """(candidate_id, job_id, shared, of, ratio) of pairs that share a trigram, by a join on trigrams instead of a cross product."""
    grams = lambda df, key: df.select(key, F.explode(trigrams(tokens(F.col("text")))).alias("gram"))
    wanted = grams(jobs, "job_id")
    size = wanted.groupBy("job_id").agg(F.count("*").alias("of")).filter(F.col("of") >= config.jd_echo_min_trigrams)
    shared = grams(texts, "candidate_id").join(few(wanted), "gram")  # the jobs' side is broadcast where a count says it is small
    shared = shared.groupBy("candidate_id", "job_id").agg(F.count("*").alias("shared"))
    return shared.join(size, "job_id").select("candidate_id", "job_id", "shared", "of", (F.col("shared") / F.col("of")).alias("ratio"))


def jd_echo_signal(ratio: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    limit = config.jd_echo_threshold
    evidence = F.when(ratio.isNull(), "job description too short to compare").otherwise(F.format_string("%.1f%% of its trigrams occur word for word", ratio * 100))
    return _signal("jd_echo", ratio > limit, (ratio - limit) / max(1e-9, 1 - limit), evidence)


def incoherence_signal(skills_tokens: Column, narrative_tokens: Column, skills_vector: Column, narrative_vector: Column, config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    near, limit = cosine(skills_vector, narrative_vector), config.incoherence_threshold
    enough = (skills_tokens >= config.incoherence_min_tokens) & (narrative_tokens >= config.incoherence_min_tokens)
    evidence = F.when(enough, F.format_string("skills and history are %.3f alike", near)).otherwise("sections too short to compare")
    return _signal("incoherence", enough & (near < limit), (limit - near) / limit, evidence)


def quiet(name: str, why: str = "not assessed") -> Column:
    """A signal that abstains."""
    return _signal(name, F.lit(False), F.lit(0.0), F.lit(why))


def penalty(severities: list[Column], config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    weighed = sum((F.lit(w) * s for w, s in zip(config.signal_weights, severities, strict=True)), F.lit(0.0))
    return F.least(F.lit(config.max_penalty), F.lit(config.max_penalty) * weighed)


def report(signals: list[Column], config: AntiGamingConfig = DEFAULT_ANTIGAMING) -> Column:
    """struct(signals, penalty, flagged) of the five signals in order."""
    return F.struct(
        F.array(*signals).alias("signals"), penalty([s.getField("severity") for s in signals], config).alias("penalty"),
        F.exists(F.array(*[s.getField("triggered") for s in signals]), lambda t: t).alias("flagged"),
    )
