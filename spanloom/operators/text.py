"""Tokens, vocabularies, corpus statistics, templated captions and dialogue grids."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import small
from spanloom.operators.rules import condition_vector, state_keys
from spanloom.schema import VOICE_KINDS

#: The token pattern (ASCII by design) and the special tokens, in order.
TOKEN = r"[a-z0-9']+|[.,!?;]"
SPECIAL = ["<pad>", "<bos>", "<eos>", "<unk>"]
#: Tokens of a vocabulary that travels with a function.
MOST_SHIPPED = 100_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def vocabulary(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """token, n, id: special tokens first, then the tokens in order of their characters.

    Ids come from two levels, so the vocabulary is not sorted in one task: counts per two first characters, then the order
    within.
    """
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    rows = counts.withColumn("__b", F.left("token", F.lit(2)))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__b").agg(F.count("*").alias("__m")).withColumn("__o", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("token"))
    ids = rows.join(F.broadcast(offsets), "__b").select("token", "n", (inside + F.col("__o") - 1 + len(SPECIAL)).cast("long").alias("id"))
    special = df.sparkSession.createDataFrame([(s, 0, i) for i, s in enumerate(SPECIAL)], "token string, n long, id long")
    return special.unionByName(ids)


def encode(df: DataFrame, id_: str, text: str, vocab: DataFrame, special: bool = True) -> DataFrame:
    """id, ids array<long>: unknown tokens as <unk>, within <bos> and <eos> if asked for.

    A vocabulary of at most MOST_SHIPPED tokens is sent to the tasks, a larger one is joined.
    """
    unk, bos, eos = SPECIAL.index("<unk>"), SPECIAL.index("<bos>"), SPECIAL.index("<eos>")
    known = vocab.where(~F.col("token").isin(SPECIAL)).select("token", "id")
    shipped = known.limit(MOST_SHIPPED + 1).toArrow()
    rows = df.select(F.col(id_).alias("row"), tokens(F.col(text)).alias("t"))
    ids = looked_up(rows, shipped, unk) if len(shipped) <= MOST_SHIPPED else joined_up(rows, known, unk)
    ends = lambda x: F.concat(F.array(F.lit(bos).cast("long")), x, F.array(F.lit(eos).cast("long")))
    return ids.select(F.col("row").alias(id_), (ends(F.col("ids")) if special else F.col("ids")).alias("ids"))


def looked_up(rows: DataFrame, vocab: pa.Table, unk: int) -> DataFrame:
    """rows(row, t array<string>) -> row, ids, from a vocabulary that travels with the function: nothing is shuffled."""
    names, numbers = vocab.column("token").combine_chunks(), vocab.column("id").to_numpy()

    def run(batches):
        for batch in batches:
            t = batch.column(1)
            at = pc.index_in(t.flatten(), value_set=names).to_numpy(zero_copy_only=False)
            missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
            ids = np.where(missing, unk, numbers[np.where(missing, 0, at).astype(np.int64)] if len(numbers) else unk)
            sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(t).fill_null(0).to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(ids.astype(np.int64)))], ["row", "ids"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<long>")


def joined_up(rows: DataFrame, vocab: DataFrame, unk: int) -> DataFrame:
    """The same for a vocabulary of any size: tokens are joined to it, and each row's put together again."""
    each = rows.withColumn("__u", F.monotonically_increasing_id()).select("__u", "row", F.posexplode_outer("t").alias("p", "token"))
    known = each.join(vocab, "token", "left").select("__u", "row", "p", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(unk))).alias("id"))
    listed = F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "id"))))
    return known.groupBy("__u", "row").agg(F.transform(listed, lambda x: x["id"]).alias("ids")).select("row", "ids")


def decode(token_list: Column) -> Column:
    """Words joined by spaces, none before punctuation, the first letter a capital; special tokens left out."""
    words = F.filter(token_list, lambda t: ~t.isin(SPECIAL))
    text = F.regexp_replace(F.array_join(words, " "), r" ([.,!?;])", "$1")
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def padded(ids: Column, length: int) -> Column:
    """struct<input,target>: the ids cut to length + 1, shifted by one, filled with 0."""
    cut = F.slice(ids, 1, length + 1)
    fill = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), length - F.size(x))))
    return F.struct(fill(F.slice(cut, 1, F.greatest(F.lit(0), F.size(cut) - 1))).alias("input"), fill(F.slice(cut, 2, F.greatest(F.lit(0), F.size(cut) - 1))).alias("target"))


def question_answer(question: Column, answer: Column, length: int, separator: int) -> Column:
    """struct<input,target> of token ids: <bos> question <sep> answer <eos> cut to length + 1 and shifted by one, filled
    with 0. Targets before the separator are 0, so that only the answer is learned; if it was cut off, none are masked."""
    one = lambda i: F.array(F.lit(i).cast("long"))
    whole = F.slice(F.concat(one(SPECIAL.index("<bos>")), question, one(separator), answer, one(SPECIAL.index("<eos>"))), 1, length + 1)
    pair = padded(whole, length)
    at = F.when(F.array_contains(pair["input"], separator), F.array_position(pair["input"], separator).cast("int") - 1).otherwise(0)
    hidden = F.transform(pair["target"], lambda x, i: F.when(i < at, F.lit(0).cast("long")).otherwise(x))
    return F.struct(pair["input"].alias("input"), hidden.alias("target"))


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    """n, distinct, distinct_ratio, vocabulary, mean_words, min_words, max_words; words are split at white space, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    rows = df.select(F.coalesce(text, F.lit("")).alias("t"), words.alias("w"))
    per_text = rows.groupBy("t").agg(F.count("*").alias("c"), F.first(F.size("w")).alias("k"))
    base = per_text.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("distinct"), F.sum(F.col("c") * F.col("k")).alias("s"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    vocab = rows.select(F.explode("w").alias("w")).distinct().agg(F.count("*").alias("vocabulary"))
    some = F.col("n") > 0
    return base.crossJoin(vocab).select(
        "n", "distinct", F.when(some, F.col("distinct") / F.col("n")).otherwise(0.0).alias("distinct_ratio"), "vocabulary",
        F.when(some, F.col("s") / F.col("n")).otherwise(0.0).alias("mean_words"), F.coalesce("lo", F.lit(0)).cast("long").alias("min_words"), F.coalesce("hi", F.lit(0)).cast("long").alias("max_words"),
    )


def dialogue_stats(df: DataFrame, question: str, answer: str, intent: str) -> DataFrame:
    """pairs, distinct_answers, distinct_questions, intents, vocabulary (of both), mean_answer_words."""
    base = df.agg(
        F.count("*").alias("pairs"), F.count_distinct(answer).alias("distinct_answers"), F.count_distinct(question).alias("distinct_questions"), F.count_distinct(intent).alias("intents"),
        F.avg(F.size(tokens(F.col(answer)))).alias("mean_answer_words"),
    )
    both = df.select(F.explode(F.concat(tokens(F.col(question)), tokens(F.col(answer)))).alias("w")).distinct().agg(F.count("*").alias("vocabulary"))
    return base.crossJoin(both)


def out_of_domain(df: DataFrame, id_: str, text: str, vocab: DataFrame, limit: float = 0.4) -> DataFrame:
    """id, n_tokens, n_unknown, ratio, uncertain: the share of tokens that the vocabulary lacks."""
    sized = df.select(F.col(id_), tokens(F.col(text)).alias("t"))
    seen = sized.select(F.col(id_), F.explode("t").alias("token")).groupBy(id_, "token").agg(F.count("*").alias("n"))
    unknown = seen.join(vocab.select("token"), "token", "left_anti").groupBy(id_).agg(F.sum("n").alias("u"))
    ratio = F.coalesce("u", F.lit(0)) / F.greatest(F.lit(1), F.size("t"))
    return sized.join(unknown, id_, "left").select(id_, F.size("t").cast("long").alias("n_tokens"), F.coalesce("u", F.lit(0)).alias("n_unknown"), ratio.alias("ratio"), (ratio > limit).alias("uncertain"))


def choose(options: Column, *seed: Column) -> Column:
    """One option by a hash of the seed columns: the same for the same seed anywhere."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *seed), 256), 1, 15), 16, 10).cast("long")
    return F.element_at(options, (F.pmod(h, F.size(options)) + 1).cast("int"))


def count_word(n: Column) -> Column:
    return F.when(n == 1, "once").when(n == 2, "twice").when(n == 3, "three times").otherwise(F.concat(n.cast("string"), F.lit(" times")))


def duration_words(seconds: Column) -> Column:
    return F.when(seconds < 2, "briefly").when(seconds < 6, "for a moment").when(seconds < 15, "for a while").otherwise("for a long time")


def compose_caption(video: Column, labels: Column, seconds: Column, voice: Column, n_voice: Column) -> Column:
    """A sentence from a clip's measurements; the same clip always gets the same words. voice is null for silence."""
    doing = F.replace(F.get(labels, F.lit(0)), F.lit("_"), F.lit(" "))
    subject = choose(F.array(*map(F.lit, ["The dog", "It"])), video, F.lit("subject"))
    act = F.concat(subject, F.lit(" is "), doing, F.lit(" "), duration_words(seconds))
    heard = F.concat(choose(F.array(*map(F.lit, [" and it gives a ", ", and it gives a "])), video, F.lit("link")), F.replace(voice, F.lit("_"), F.lit(" ")), F.lit(" "), count_word(n_voice))
    alone = F.concat(subject, F.lit(" gives a "), F.replace(voice, F.lit("_"), F.lit(" ")), F.lit(" "), count_word(n_voice))
    silent = choose(F.array(*map(F.lit, ["", " and stays quiet"])), video, F.lit("silence"))
    return (
        F.when(doing.isNotNull() & voice.isNotNull(), F.concat(act, heard, F.lit(".")))
        .when(doing.isNotNull(), F.concat(act, silent, F.lit(".")))
        .when(voice.isNotNull(), F.concat(alone, F.lit(".")))
        .otherwise("Nothing much happens in this clip.")
    )


def generate_captions(annotations: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """A corpus row (sources.dialogues) per annotation (video, labels, start, end, group), its caption composed from what is
    measured: labels, length, and of ``audio`` (video, kinds map<string,long>, arousal, valence, vocal_fraction) the kind
    heard most often, the first by name of equals. An end that is missing or before the start gives a length of 0."""
    seconds = F.greatest(F.lit(0.0), F.coalesce("end", F.lit(0.0)) - F.col("start"))
    rows = annotations.select("video", "labels", "start", seconds.alias("duration"), F.coalesce("group", F.lit("")).alias("group"))
    if audio is None:
        rows = rows.withColumns({"kinds": F.lit(None).cast("map<string,long>")} | {c: F.lit(None).cast("double") for c in ("arousal", "valence", "vocal_fraction")})
    else:
        rows = rows.join(audio.select("video", F.col("kinds").cast("map<string,long>").alias("kinds"), "arousal", "valence", "vocal_fraction"), "video", "left")
    counts = F.filter(F.transform(F.map_entries("kinds"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("kind"))), lambda x: x["n"] < 0)
    rows = rows.withColumn("top", F.array_min(counts))
    key = F.concat_ws(":", "video", F.format_string("%.3f", F.col("start").cast("double")))
    caption = compose_caption(key, F.col("labels"), F.col("duration"), F.col("top.kind"), -F.col("top.n"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("arousal", "valence", "vocal_fraction")]
    voice = F.struct(F.coalesce("kinds", F.create_map().cast("map<string,long>")).alias("kinds"), *zero)
    return rows.select("video", caption.alias("caption"), "labels", "duration", "group", voice.alias("audio"))


def corpus_to_examples(corpus: DataFrame, behaviours: list[str]) -> DataFrame:
    """video, condition array<double>, caption of a corpus: known labels share 0.85 each on a floor of 0.15 / n, or all 0."""
    n = max(1, len(behaviours))
    known = F.size(F.array_intersect("labels", F.array(*map(F.lit, behaviours)))) > 0
    scores = F.array(*[F.when(known, F.when(F.array_contains("labels", b), 0.85).otherwise(0.0) + 0.15 / n).otherwise(0.0) for b in behaviours])
    vector = condition_vector(scores, F.col("audio.kinds"), F.col("audio.arousal"), F.col("audio.valence"), F.col("audio.vocal_fraction"), F.col("duration"))
    return corpus.select("video", vector.alias("condition"), "caption")


def dialogue_grid(spark, behaviours: list[str], intents: list[str], arousals=(0.15, 0.4, 0.7, 0.9), valences=(-0.7, -0.3, 0.0, 0.4, 0.8), repeats: int = 2) -> DataFrame:
    """Every state x intent x repeat with its lookup keys: a product of fixed, small lists."""
    dims = [
        spark.createDataFrame([(b,) for b in behaviours], "behaviour string"),
        spark.createDataFrame([(v,) for v in ["", *VOICE_KINDS]], "voice string"),
        spark.createDataFrame([(a,) for a in arousals], "arousal double"),
        spark.createDataFrame([(v,) for v in valences], "valence double"),
        spark.createDataFrame([(i,) for i in intents], "intent string"),
        spark.createDataFrame([(r,) for r in range(repeats)], "repeat int"),
    ]
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)
    return grid.withColumn("keys", state_keys(F.col("behaviour"), F.col("voice"), F.col("arousal"), F.col("valence")))


def compose_answers(grid: DataFrame, table: DataFrame) -> DataFrame:
    """Adds answer: of the first key that has lines for the intent (table: intent, key, lines array<string>), one by hash."""
    tried = grid.select("*", F.posexplode("keys").alias("p", "key")).join(small(table), ["intent", "key"])
    row = ["behaviour", "voice", "arousal", "valence", "intent", "repeat"]
    found = tried.groupBy(*row).agg(F.min(F.struct("p", "lines")).alias("m"))
    line = choose(F.col("m.lines"), *[F.col(c).cast("string") for c in row])
    joined = grid.join(found.select(*row, line.alias("line")), row, "left")
    return joined.select(*grid.columns, F.coalesce("line", F.lit("nothing much to report")).alias("answer"))
