"""Secret scans judged by corpus-wide ownership, in DataFrame operations only.

Base kinds (assign, access, hex) are always reported. Further kinds are candidates: their spans are added where the value
is live. For every candidate value, the distinct repositories of each owner that show its hash are counted over the whole
corpus. A value is a widely copied example if ``copied_owners`` or more owners show it and none of them holds more than half
of its repositories; a value that others merely quote from one owner stays that owner's. A value is live if it is not
copied and looks like a credential: DIFFERENT or more different characters, and none of the words of DUMMY.

Positions come from splitting the text at a pattern: piece and match lengths add up to code point offsets. Counts go
through (hash, owner) groups first, so a value that a third of all rows repeat is summed before it is shuffled; the join
of candidates to counts is an equi-join that adaptive execution splits where a hash is hot.

Edge cases: null text is empty; equal documents each get their row; a null owner counts as one owner, "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import saved

#: Kind, pattern, group that holds the value, least characters of that group, strings of which a text with a match has one.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, [":", "="]),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ["AKIA"]),
    ("hex", r"[0-9a-f]{32,}", 0, 32, []),
]
ADDED = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64, ["PRIVATE KEY"]),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ["_"]),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ["xox"]),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 24, ["eyJ"]),
    ("url", r"[a-z]+://[^\s/:@]+:[^\s/:@]{8,}@", 0, 16, ["://"]),
]
KINDS = BASE + ADDED
COPIED_OWNERS, DIFFERENT = 3, 6
DUMMY = "example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|0000|1234567"
SPAN = "struct<start:int,ord:int,kind:string,end:int,hash:bigint>"
MASK = "[SECRET]"


PART = "struct<ord:int,i:int,gap:int,size:int,enough:boolean,hash:bigint,looks:boolean>"


def looks_real(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT) & ~F.rlike(F.lower(value), F.lit(DUMMY))


def kind_parts(text: Column, ord_: int) -> Column:
    """array<PART> of one kind's matches in order: characters since the last match, its size, whether its value is long enough."""
    _, pattern, group, least, needed = KINDS[ord_]
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(
        parts,
        lambda p, i: F.struct(
            F.lit(ord_).alias("ord"), i.alias("i"), p["gap"].alias("gap"), F.length(p["whole"]).alias("size"), (F.length(p["value"]) >= least).alias("enough"), F.xxhash64(p["value"]).alias("hash"),
            looks_real(p["value"]).alias("looks"),
        ),
    )
    there = F.rlike(text, F.lit(pattern))
    for part in needed[:1]:
        some = F.contains(text, F.lit(part))
        for other in needed[1:]:
            some = some | F.contains(text, F.lit(other))
        there = some & there
    return F.when(there, found).otherwise(F.array().cast(f"array<{PART}>"))


def placed(rows: DataFrame) -> DataFrame:
    """rows(uid, owner, repo, parts) -> uid, owner, repo, hash, looks, s: a SPAN per match that is long enough.

    Offsets are running sums over a document's matches of a kind, so their time grows as their number.
    """
    line = Window.partitionBy("uid", "p.ord").orderBy("p.i").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.where(F.size("parts") > 0).select("uid", "owner", "repo", F.explode("parts").alias("p"))
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(line).cast("int")
    ended = each.withColumn("end", end).where("p.enough")
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    span = F.struct((F.col("end") - F.col("p.size")).alias("start"), F.col("p.ord").alias("ord"), F.element_at(kinds, F.col("p.ord") + 1).alias("kind"), F.col("end").alias("end"), F.col("p.hash").alias("hash"))
    return ended.select("uid", "owner", "repo", F.col("p.hash").alias("hash"), F.col("p.looks").alias("looks"), span.alias("s"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", keep: list[str] | None = None, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """docs(doc_id, text, owner, repository) -> doc_id, row struct of the ``keep`` columns if given, base and spans
    array<SPAN> in order of start, n_live, n_copied, most_owners, most_repositories.

    Repository defaults to the document itself, for corpora whose rows name none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(*[kind_parts(text, i) for i in range(len(KINDS))])
    rows = saved(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            *([F.struct(*[f"`{c}`" for c in keep]).alias("row")] if keep else []),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"),
            parts.alias("parts"),
        ),
        "secrets",
    )
    flat = placed(rows)
    owners = flat.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("repos").alias("most")
    )
    copied = (F.col("n_owners") >= copied_owners) & (2 * F.col("most") <= F.col("n_repos"))
    judged = (
        flat.join(owners, "hash")
        .select("uid", "s", copied.alias("copied"), (~copied & F.col("looks")).alias("live"), "n_owners", "n_repos")
        .groupBy("uid")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("s.ord") < len(BASE), F.col("s")))).alias("base"),
            F.array_sort(F.collect_list(F.when(F.col("live") | (F.col("s.ord") < len(BASE)), F.col("s")))).alias("spans"),
            F.count_if("live").alias("n_live"),
            F.count_if("copied").alias("n_copied"),
            F.max("n_owners").alias("most_owners"),
            F.max("n_repos").alias("most_repositories"),
        )
    )
    none = F.array().cast(f"array<{SPAN}>")
    some, counts = F.size("parts") > 0, ("n_live", "n_copied", "most_owners", "most_repositories")
    own = ["doc_id", *(["row"] if keep else [])]
    # only rows with matches meet the judged spans; the others, with their texts, are not shuffled
    hit = rows.where(some).join(judged, "uid", "left")
    hit = hit.select(*own, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    empty = F.when(~some, none)
    clean = rows.where(~some).select(*own, empty.alias("base"), empty.alias("spans"), *[F.lit(0).cast("long").alias(c) for c in counts])
    return hit.unionByName(clean)


def redact(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every span, sorted by start, replaced by the mask; overlapping spans share one."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).alias("out"))
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1)))


def op4(spark, sf_dir) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k[0]) for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


def _oracle() -> str:
    parts = []
    for i, (kind, pattern, group, least, _) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT rid, owner, doc_id, {i} AS ord, '{kind}' AS kind,
            list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS s,
            length(m[i]) AS n, v[i] AS v
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, owner, doc_id, string_split_regex(text, '{p}') AS g,
              regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM d)) WHERE length(v[i]) >= {least}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
c AS ({' UNION ALL '.join(parts)}),
o AS (SELECT v, owner, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS n FROM c GROUP BY v, owner),
f AS (SELECT v, count(*) >= {COPIED_OWNERS} AND 2 * max(n) <= sum(n) AS copied, len(list_distinct(string_split(v, ''))) >= {DIFFERENT} AND NOT regexp_matches(lower(v), '{DUMMY}') AS looks FROM o GROUP BY v),
j AS (SELECT rid, ord, kind, s, CAST(s AS VARCHAR) || ':' || CAST(s + c.n AS VARCHAR) AS pos, copied, NOT copied AND looks AS live FROM c JOIN f ON c.v = f.v),
r AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(kind || ':' || pos, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS base,
  string_agg(kind || ':' || pos, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)} OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN r USING (rid)"""


ORACLE = _oracle()
