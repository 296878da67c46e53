"""Weighted rule aggregation: affect, voice typing, audio readings, blending, advice, state lookup, label enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import small
from spanloom.operators.spans import dedupe_utterances
from spanloom.schema import NOT_THE_DOG, VOICE_KINDS


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def duration() -> Column:
    return F.greatest(F.lit(0.0), F.col("end") - F.col("start"))


def time_per_behaviour(spans: DataFrame, key: list[str]) -> DataFrame:
    return spans.groupBy(*key, "behaviour").agg(F.sum(duration()).alias("seconds"))


def dominant(totals: DataFrame, key: list[str]) -> DataFrame:
    """key, behaviour, seconds: the behaviour with most time, the first by name of equals."""
    best = totals.groupBy(*key).agg(F.min(F.struct((-F.col("seconds")).alias("s"), "behaviour")).alias("m"))
    return best.select(*key, F.col("m.behaviour").alias("behaviour"), (-F.col("m.s")).alias("seconds"))


def quadrant(valence: Column, arousal: Column, coverage: Column) -> Column:
    """The names of the regions of the valence-arousal plane and their limits."""
    return (
        F.when(coverage < 0.15, "not enough to say")
        .when((arousal >= 0.6) & (valence >= 0.25) & (F.abs(valence) > 0.3), "excited and enjoying it")
        .when((arousal >= 0.6) & (valence >= 0.25), "excited")
        .when((arousal >= 0.6) & (valence <= -0.2), "agitated or stressed")
        .when(arousal >= 0.6, "highly activated, valence unclear")
        .when((arousal <= 0.3) & (valence >= 0.2), "relaxed and content")
        .when((arousal <= 0.3) & (valence <= -0.2), "withdrawn or uncomfortable")
        .when(arousal <= 0.3, "quiet and settled")
        .when(valence >= 0.25, "comfortable and engaged")
        .when(valence <= -0.2, "uneasy")
        .otherwise("neutral")
    )


def read_affect(spans: DataFrame, affect: DataFrame, totals: DataFrame, key: list[str], known: int | None = None, min_score: float = 0.0) -> DataFrame:
    """One reading per row of ``totals`` (key, duration): valence, arousal, coverage, confidence, label, n_evidence, stress.

    spans: key, behaviour, start, end, score. Weights are duration x score x the dimension's weight. ``known`` is the
    number of behaviours with an affect that the model can see; fewer than 8 lower the confidence.
    """
    dim = small(affect.withColumnRenamed("weight", "w"))
    rows = spans.join(dim, "behaviour").where((F.col("score") > 0) & (F.col("score") >= min_score)).withColumn("d", duration())
    rows = rows.withColumn("weight", F.col("d") * F.col("score") * F.col("w")).where("weight > 0")
    read = rows.groupBy(*key).agg(
        F.sum(F.col("valence") * F.col("weight")).alias("v"), F.sum(F.col("arousal") * F.col("weight")).alias("a"), F.sum("weight").alias("t"), F.sum("d").alias("covered"),
        F.count_distinct("behaviour").alias("n_evidence"), F.array_sort(F.collect_set(F.when(F.col("stress"), F.col("behaviour")))).alias("stress"),
    )
    coverage = F.least(F.lit(1.0), F.col("covered") / F.greatest(F.col("duration"), F.lit(1e-6)))
    breadth = 1.0 if known is None else 0.45 + 0.55 * min(1.0, known / 8.0)
    out = totals.join(read, key, "left").withColumn("coverage", F.coalesce(coverage, F.lit(0.0)))
    none = F.col("t").isNull()
    confidence = clamp(F.least(F.lit(1.0), F.col("coverage") * 1.2) * breadth * F.when(F.col("n_evidence") == 1, 0.7).otherwise(1.0), 0.0, 1.0)
    out = out.withColumn("valence", F.when(none, 0.0).otherwise(clamp(F.col("v") / F.col("t"), -1.0, 1.0)))
    out = out.withColumn("arousal", F.when(none, 0.0).otherwise(clamp(F.col("a") / F.col("t"), 0.0, 1.0)))
    out = out.withColumn("confidence", F.when(none, 0.0).otherwise(confidence))
    out = out.withColumn("label", F.when(none, "not enough to say").otherwise(quadrant(F.col("valence"), F.col("arousal"), F.col("coverage"))))
    stress = F.coalesce("stress", F.array().cast("array<string>"))
    return out.select(*key, "duration", "valence", "arousal", "coverage", "confidence", "label", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), stress.alias("stress"))


def needs_review(valence: Column, arousal: Column, n_stress: Column) -> Column:
    return (valence < -0.15) | (n_stress >= 2) | ((arousal > 0.7) & (valence < 0))


def arousal_fraction(spans: DataFrame, totals: DataFrame, key: list[str], flags: list[str]) -> DataFrame:
    """key, arousal_fraction: flagged seconds over the duration, at most 1; overlapping spans count twice."""
    flagged = spans.where(F.col("behaviour").isin(flags)).groupBy(*key).agg(F.sum(duration()).alias("s"))
    share = F.when(F.col("duration") > 0, F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / F.col("duration"))).otherwise(0.0)
    return totals.join(flagged, key, "left").select(*key, share.alias("arousal_fraction"))


def speech_score(f0: Column, periodicity: Column, seconds: Column, modulation: Column, formant: Column, high: Column) -> Column:
    """How much an event's features look like speech, 0 to 1."""
    add = lambda when, x: F.when(when, x).otherwise(0.0)
    total = add(f0.between(85.0, 300.0), 0.35) + add(formant > 0.6, 0.2) + add((modulation > 0.05) & (modulation < 0.45), 0.2)
    total = total + add(seconds > 0.6, 0.15) + add(periodicity > 0.45, 0.1) - add(high > 0.25, 0.2)
    return F.when((seconds < 0.25) | (f0 <= 0), 0.0).otherwise(clamp(total, 0.0, 1.0))


def voice_kind(df: DataFrame, voice: DataFrame) -> DataFrame:
    """Types events by their features: adds kind, confidence, valence, arousal, concerning.

    df: seconds, f0, periodicity, flatness, centroid, loudness, modulation, formant, high, rate. The first rule wins.
    """
    c = F.col
    speech = speech_score(c("f0"), c("periodicity"), c("seconds"), c("modulation"), c("formant"), c("high"))
    tonal = (c("periodicity") > 0.35) & (c("flatness") < 0.30)
    bark = c("seconds").between(0.05, 0.6) & (c("loudness") > -40) & (c("centroid") > 400)
    rules = [
        (speech > 0.6, "speech", F.least(F.lit(0.6), speech)),
        ((c("seconds") < 0.18) & (c("f0") > 600) & (c("periodicity") > 0.4), "yelp", F.lit(0.55)),
        ((c("seconds") >= 0.3) & (c("f0") > 0) & (c("f0") < 350) & ((c("flatness") > 0.1) | (c("periodicity") < 0.65)), "growl", F.lit(0.55)),
        (c("seconds").between(0.7, 3.5) & c("f0").between(200, 1400) & (c("periodicity") > 0.5) & (c("modulation") > 0.12), "howl", F.lit(0.5)),
        ((c("seconds") >= 0.22) & (c("f0") > 450) & (c("periodicity") > 0.35), "whine", F.lit(0.55)),
        (bark & (c("f0") > 0) & (c("f0") < 450) & (c("flatness") > 0.14), "bark_alarm", F.lit(0.5)),
        (bark & (c("f0") >= 450) & tonal, "bark_excited", F.lit(0.5)),
        (bark, "bark", F.lit(0.45)),
        ((c("seconds") > 0.6) & (c("flatness") > 0.35) & (c("centroid") < 2500) & ~tonal, "pant", F.lit(0.4)),
    ]
    kind, confidence = F.lit("sound"), F.lit(0.35)
    for when, name, value in reversed(rules):
        kind, confidence = F.when(when, F.lit(name)).otherwise(kind), F.when(when, value).otherwise(confidence)
    typed = df.withColumn("__k", kind).withColumn("__c", confidence)
    alarm = F.col("__k").isin("bark", "bark_excited") & (c("rate") >= 3) & (c("f0") < 700)
    typed = typed.withColumn("kind", F.when(alarm, F.lit("bark_alarm")).otherwise(F.col("__k")))
    typed = typed.withColumn("__c", F.when(alarm, F.least(F.lit(0.55), F.col("__c") + 0.05)).otherwise(F.col("__c")))
    quiet = (c("loudness") < -45) & (F.col("kind") != "speech")
    typed = typed.withColumn("confidence", F.when(quiet, F.col("__c") * 0.7).otherwise(F.col("__c"))).drop("__k", "__c")
    aroused = F.when((c("rate") >= 3) & F.col("kind").startswith("bark"), F.least(F.lit(1.0), F.col("arousal") + 0.1)).otherwise(F.col("arousal"))
    return typed.join(small(voice), "kind").withColumn("arousal", aroused)


def read_audio(events: DataFrame, totals: DataFrame, key: list[str]) -> DataFrame:
    """One reading per row of ``totals`` (key, duration) from typed events (key, kind, seconds, confidence, valence, arousal)."""
    own = events.where(~F.col("kind").isin(NOT_THE_DOG)).withColumn("w", F.col("confidence") * clamp(F.col("seconds"), 0.05, 1.0))
    read = own.groupBy(*key).agg(
        F.sum("w").alias("t"), F.sum(F.col("valence") * F.col("w")).alias("v"), F.sum(F.col("arousal") * F.col("w")).alias("a"), F.count("*").alias("n"), F.sum("seconds").alias("s")
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    weighted = lambda x: zero(F.when(F.col("t") > 0, F.col(x) / F.col("t")))
    confidence = F.least(F.lit(1.0), F.col("t") / 2.0) * F.least(F.lit(1.0), 0.4 + 0.15 * F.col("n"))
    share = F.least(F.lit(1.0), zero(F.col("s")) / F.greatest(F.col("duration"), F.lit(1e-6)))
    return totals.join(read, key, "left").select(
        *key, weighted("v").alias("valence"), weighted("a").alias("arousal"), zero(confidence).alias("confidence"), share.alias("vocal_fraction"), F.coalesce("n", F.lit(0)).alias("n_events")
    )


def most_telling(events: DataFrame, key: list[str], most: int = 200) -> DataFrame:
    """The longest ``most`` events per key, in the order of their starts among equals."""
    order = Window.partitionBy(*key).orderBy((F.col("end") - F.col("start")).desc(), "start")
    return events.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def blend(df: DataFrame) -> DataFrame:
    """Of affect and audio readings in one row (affect_* and audio_* valence, arousal, confidence; urgent_arousal, null if
    nothing urgent was heard): valence, arousal, confidence, disagree."""
    w1 = F.when(F.col("affect_confidence") > 0, F.greatest(F.lit(0.2), "affect_confidence")).otherwise(0.0)
    w2 = F.when(F.col("audio_confidence") > 0, F.greatest(F.lit(0.2), "audio_confidence") * 1.3).otherwise(0.0)
    rows = df.withColumn("w1", w1).withColumn("w2", w2).withColumn("t", F.col("w1") + F.col("w2"))
    mean = lambda x: F.when(F.col("t") > 0, (F.col(f"affect_{x}") * F.col("w1") + F.col(f"audio_{x}") * F.col("w2")) / F.col("t")).otherwise(0.0)
    rows = rows.withColumn("v", mean("valence")).withColumn("a", mean("arousal"))
    urgent = F.col("urgent_arousal").isNotNull()
    disagree = urgent & (((F.col("affect_confidence") > 0) & (F.col("affect_valence") > 0.2)) | (F.col("v") > 0.15))
    return (
        rows.withColumn("valence", F.when(disagree, F.least("v", F.lit(0.15))).otherwise(F.col("v")))
        .withColumn("arousal", F.when(urgent, F.greatest("a", "urgent_arousal")).otherwise(F.col("a")))
        .withColumn("confidence", F.least(F.lit(1.0), F.col("t") / 2.2))
        .withColumn("disagree", disagree)
        .drop("w1", "w2", "t", "v", "a")
    )


def band(x: Column, low: float, high: float) -> Column:
    return F.when(x >= high, "high").when(x <= low, "low").otherwise("medium")


def valence_band(x: Column) -> Column:
    return F.when(x >= 0.2, "positive").when(x <= -0.15, "negative").otherwise("neutral")


def pick(options: Column, seed: Column) -> Column:
    """The option at floor(|seed| * 1000) modulo their number."""
    return F.element_at(options, (F.pmod(F.floor(F.abs(seed) * 1000), F.size(options)) + 1).cast("int"))


def translate(spans: DataFrame, events: DataFrame, state: DataFrame, key: list[str], behaviour_lines: DataFrame, voice_lines: DataFrame, headlines: DataFrame, least_seconds: float = 0.4) -> DataFrame:
    """One row per row of ``state``: key, headline, utterances in order, urgent kinds, heard, saw, valence, arousal,
    confidence, disagree, notes.

    spans: key, behaviour, start, end, score. events: key, kind, start, end, f0, confidence, concerning. state: blend()'s
    columns. behaviour_lines (behaviour, lines array<string>), voice_lines (kind, lines) and headlines (arousal_band,
    valence_band, lines) hold the phrases. A span shorter than ``least_seconds`` says nothing. Voice comes before movement
    where both start together; a phrase that repeats the last one within 1.5 s extends it. The surest urgent utterance is
    the headline, else the phrase of the state's bands.
    """
    double = lambda c: F.col(c).cast("double")
    seen = spans.where(duration() >= least_seconds).join(small(behaviour_lines), "behaviour")
    basis = F.format_string("%s %.1f-%.1fs", "behaviour", double("start"), double("end"))
    seen = seen.select(*key, "start", "end", pick(F.col("lines"), F.col("start") + F.col("score")).alias("text"), double("score").alias("confidence"), F.lit("behaviour").alias("source"), basis.alias("basis"), F.lit(False).alias("urgent"), F.lit(1).alias("after"))
    own = events.where(~F.col("kind").isin(NOT_THE_DOG))
    said = own.join(small(voice_lines), "kind")
    said = said.select(
        *key, "start", "end", pick(F.col("lines"), F.col("start") + F.col("f0") / 1000.0).alias("text"), double("confidence").alias("confidence"), F.lit("voice").alias("source"),
        F.format_string("%s %.1fs", "kind", double("start")).alias("basis"), F.col("concerning").alias("urgent"), F.lit(0).alias("after"),
    )
    lines = seen.unionByName(said)
    carry = ["confidence", "source", "basis", "urgent"]
    kept = dedupe_utterances(lines, key, ["start", "after", "basis"], carry=carry)
    shown = ["start", "end", "text", *carry]
    told = kept.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), (F.col("source") != "voice").alias("after"), *[c for c in shown]))).alias("rows"),
        F.max_by("text", F.when(F.col("urgent"), F.struct("confidence", (-F.col("start")).alias("s")))).alias("loudest"),
    )
    told = told.select(*key, F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in shown])).alias("utterances"), "loudest")
    heard = events.groupBy(*key).agg(
        F.max(~F.col("kind").isin(NOT_THE_DOG)).alias("heard"), F.count_if(F.col("kind") == "speech").alias("people"),
        F.array_sort(F.collect_set(F.when(F.col("concerning") & ~F.col("kind").isin(NOT_THE_DOG), F.col("kind")))).alias("urgent"),
    )
    saw = spans.select(*key).distinct().withColumn("saw", F.lit(True))
    moods = state.withColumn("arousal_band", band(F.col("arousal"), 0.3, 0.6)).withColumn("valence_band", valence_band(F.col("valence")))
    rows = moods.join(small(headlines), ["arousal_band", "valence_band"], "left").join(told, key, "left").join(heard, key, "left").join(saw, key, "left")
    no = F.lit(False)
    heard_, saw_ = F.coalesce("heard", no), F.coalesce("saw", no)
    mood = pick(F.col("lines"), F.col("valence") + F.col("arousal"))
    notes = F.array(
        F.when(F.col("people") > 0, F.concat(F.col("people").cast("string"), F.lit(" sounds were people talking and are ignored"))),
        F.when(F.col("disagree"), F.concat(F.lit("picture and sound disagree: heard "), F.array_join("urgent", ", "))),
        F.when(~heard_ & ~saw_, F.lit("nothing was seen or heard")).when(~heard_, F.lit("silent: read from movement alone")).when(~saw_, F.lit("nothing seen: read from the voice alone")),
    )
    none = F.array().cast("array<string>")
    return rows.select(
        *key, F.when(heard_ | saw_, F.coalesce("loudest", mood)).otherwise("Not much to go on right now.").alias("headline"),
        F.coalesce("utterances", F.array().cast(told.schema["utterances"].dataType)).alias("utterances"), F.coalesce("urgent", none).alias("urgent"), heard_.alias("heard"), saw_.alias("saw"),
        "valence", "arousal", F.when(heard_ | saw_, F.col("confidence")).otherwise(0.0).alias("confidence"), "disagree", F.array_compact(notes).alias("notes"),
    )


def advise(heard: DataFrame, seen: DataFrame, state: DataFrame, key: list[str], voice_rules: DataFrame, behaviour_rules: DataFrame, most: int = 6, least_seconds: float = 0.5) -> DataFrame:
    """key, rank, text, priority: at most ``most`` suggestions, by priority and then in the order they were found.

    heard: key, start, kind. seen: key, behaviour, seconds. state: key, valence, arousal, confidence, n_stress.
    Rules: kind or behaviour, place (order within it), text, priority. A text is given once, where it was found first.
    """
    voice = heard.where(~F.col("kind").isin(NOT_THE_DOG)).join(small(voice_rules), "kind")
    voice = voice.select(*key, "text", "priority", F.lit(0).alias("a"), F.col("start").cast("double").alias("b"), F.col("kind").alias("c"), "place")
    acts = seen.where(F.col("seconds") >= least_seconds).join(small(behaviour_rules), "behaviour")
    acts = acts.select(*key, "text", "priority", F.lit(1).alias("a"), (-F.col("seconds")).alias("b"), F.col("behaviour").alias("c"), "place")
    sure = F.col("confidence") > 0.2
    low = sure & (F.col("valence") < -0.2)
    rules = F.array(
        F.when(low & (F.col("arousal") > 0.6), F.struct(F.lit("worked up and unhappy: lower the pressure").alias("text"), F.lit(1).alias("priority"), F.lit(1).alias("place"))),
        F.when(low & (F.col("arousal") < 0.35), F.struct(F.lit("quiet and withdrawn: watch for a change").alias("text"), F.lit(2).alias("priority"), F.lit(2).alias("place"))),
        F.when(sure & (F.col("n_stress") >= 2), F.struct(F.lit("several stress signals: look for what they share").alias("text"), F.lit(2).alias("priority"), F.lit(3).alias("place"))),
    )
    felt = state.select(*key, F.explode(F.array_compact(rules)).alias("r"))
    felt = felt.select(*key, "r.text", "r.priority", F.lit(2).alias("a"), F.lit(0.0).alias("b"), F.lit("").alias("c"), "r.place")
    found = voice.unionByName(acts).unionByName(felt)
    first = found.groupBy(*key, "text").agg(F.min(F.struct("a", "b", "c", "place")).alias("o"), F.min_by("priority", F.struct("a", "b", "c", "place")).alias("priority"))
    order = Window.partitionBy(*key).orderBy("priority", "o", "text")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*key, "rank", "text", "priority")


def state_keys(behaviour: Column, voice: Column, arousal: Column, valence: Column) -> Column:
    """array<string> of lookup keys, the most specific first: voice, behaviour, mood band, default."""
    strength = F.when(arousal >= 0.55, "high").otherwise("low")
    mood = F.when(valence >= 0.2, F.concat(F.lit("positive_"), strength)).when(valence <= -0.15, F.concat(F.lit("negative_"), strength)).otherwise("neutral")
    return F.filter(F.array(F.nullif(voice, F.lit("")), behaviour, mood, F.lit("default")), lambda x: x.isNotNull())


def resolve(states: DataFrame, table: DataFrame, id_: str, keys: str) -> DataFrame:
    """id, key, value of the first key that the table (key, value) has."""
    tried = states.select(F.col(id_).alias("id"), F.posexplode(keys).alias("p", "key")).join(small(table), "key")
    return tried.groupBy("id").agg(F.min(F.struct("p", "key", "value")).alias("m")).select("id", "m.key", "m.value")


def state_of(readings: DataFrame, key: list[str]) -> DataFrame:
    """key, behaviour (standing if none), voice, arousal, valence; a reading of 0 counts as none, so the other channel's is taken."""
    first = lambda x: F.coalesce(F.nullif(F.col(f"affect_{x}"), F.lit(0.0)), F.col(f"audio_{x}"), F.lit(0.0))
    return readings.select(*key, F.coalesce("behaviour", F.lit("standing")).alias("behaviour"), F.coalesce("voice", F.lit("")).alias("voice"), first("arousal").alias("arousal"), first("valence").alias("valence"))


def enrich(annotations: DataFrame, audio: DataFrame, on: str, label: str, kinds: list[str], min_count: int = 1, min_confidence: float = 0.0) -> DataFrame:
    """Adds the label where enough events of the kinds were heard; never removes one. Adds events and status.

    audio: ``on``, kinds map<string,int>, confidence. status: already_labelled, skipped_missing_audio, added, no_audio_signal.
    """
    heard = F.aggregate(F.array(*map(F.lit, kinds)), F.lit(0), lambda s, k: s + F.coalesce(F.try_element_at(F.col("__kinds"), k), F.lit(0)))
    rows = annotations.join(audio.select(on, F.col("kinds").alias("__kinds"), F.col("confidence").alias("__c")), on, "left").withColumn("events", heard)
    status = (
        F.when(F.array_contains("labels", label), "already_labelled")
        .when(F.col("__kinds").isNull(), "skipped_missing_audio")
        .when((F.col("events") >= min_count) & (F.coalesce("__c", F.lit(0.0)) >= min_confidence), "added")
        .otherwise("no_audio_signal")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("labels", F.when(F.col("status") == "added", F.array_append("labels", label)).otherwise(F.col("labels"))).drop("__kinds", "__c")


def voice_counts_vector(kinds: Column) -> Column:
    """array<double>: log1p of each voice kind's count, over 3."""
    return F.array(*[F.log1p(F.coalesce(F.try_element_at(kinds, F.lit(k)), F.lit(0)).cast("double")) / 3.0 for k in VOICE_KINDS])


def condition_vector(scores: Column, kinds: Column, arousal: Column, valence: Column, fraction: Column, seconds: Column) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return F.concat(scores, voice_counts_vector(kinds), F.array(zero(arousal), zero(valence), zero(fraction), F.log1p(F.greatest(F.lit(0.0), seconds)) / 4.0))


def state_vector(behaviour: Column, voice: Column, arousal: Column, valence: Column, behaviours: list[str]) -> Column:
    """One-hot behaviour smoothed by .85 and .15 / n, one-hot voice, arousal, valence."""
    n = max(1, len(behaviours))
    hot = [F.when(behaviour == b, 0.85).otherwise(0.0) + 0.15 / n for b in behaviours]
    return F.array(*hot, *[F.when(voice == v, 1.0).otherwise(0.0) for v in VOICE_KINDS], arousal, valence)
