"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

A text is scanned once for each kind of candidate. The candidates' values are hashed, and the hashes are counted over
the whole corpus by distinct repositories and distinct owners. A value that many owners hold, or that stands in many
repositories, is a copied example; one that only a few hold looks live. Long mixed tokens that no pattern names are reported only where the frequency says
that they belong to few owners.

Only spans and hashes are shuffled, never texts or the secrets themselves, and hashes are counted before each shuffle,
so a key that is copied everywhere is no hot group. Null texts count as empty; a null owner or repository counts as
one of its own; rows are kept one to one, and rows that repeat an id and a text get equal spans. Work within a text grows
with its spans, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, join_hot, packed, q, saved, table

#: Fixed patterns: kind, expression, group of the value, least length of what is tested, group that is tested.
KINDS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "owner": (r"[A-Za-z0-9+/_-]{32,}", 0, 32),
}
BASE = ("assign", "access", "hex")
MAX_OWNERS = 2
MAX_REPOSITORIES = 4
_RUN = 128


def _mixed(value: Column) -> Column:
    """Has capitals, small letters and digits: what random tokens have and words don't."""
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_runs(items: Column, body) -> Column:
    """body of each stretch of `_RUN` items, as an array."""
    return _let(items, lambda xs: F.transform(F.sequence(F.lit(0), (F.size(xs) / _RUN).cast("int")), lambda k: body(F.slice(xs, k * _RUN + 1, _RUN))))


def _before(numbers: Column, joined) -> Column:
    """For each number those before it joined, by a function that can join in any grouping and 0 does not change: within runs
    first, then over the runs."""
    none = F.expr("cast(array() as array<int>)")

    def within(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), none.alias("before"))
        return F.aggregate(xs, start, lambda s, x: F.struct(joined(s["total"], x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))

    def over(runs: Column) -> Column:
        start = within(F.transform(runs, lambda r: r["total"]))["before"]
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), start.alias("start")), lambda z: F.transform(z["run"]["before"], lambda b: joined(b, z["start"]))))

    return _let(_in_runs(numbers, within), over)


def _sums_before(numbers: Column) -> Column:
    return _before(numbers, lambda a, b: a + b)


def _apart_from_others(spans: Column) -> Column:
    """Overlapping spans, sorted by start, as one: a span that begins where all before it have ended opens a new one, which
    ends where the spans before the next opening have."""
    reached = _before(F.transform(spans, lambda s: s["end"]), F.greatest)
    opens = F.filter(F.zip_with(spans, reached, lambda s, b: F.struct(s["start"].alias("start"), b.alias("before"))), lambda x: x["start"] >= x["before"])
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return _let(opens, lambda xs: F.transform(xs, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.try_element_at(xs, i + 2)["before"], last).alias("end"))))


def _spans(text: Column, kind: str) -> Column:
    """All matches of one kind, as structs with code-point positions, from the pieces between the matches."""
    pattern, group, least = KINDS[kind]
    expr = F.lit(pattern)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, expr, F.lit(0)).alias("whole"), F.regexp_extract_all(text, expr, F.lit(group)).alias("value"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,hash:string>>)")
    rank = list(KINDS).index(kind)

    def one(z: Column) -> Column:
        start = z["before"] + z["gap"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + z["size"]).alias("end"), F.sha2(z["value"], 256).alias("hash"))

    def fits(z: Column) -> Column:
        long = z["value"].isNotNull() & (F.length(z["value"]) >= least)
        return long if kind in BASE else long & _mixed(z["value"])

    def placed(ps: Column) -> Column:
        sized = F.transform(ps, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.coalesce(F.length(p["whole"]), F.lit(0)).alias("size"), F.when(p["whole"].isNotNull(), p["value"]).alias("value")))
        return _let(sized, lambda xs: F.transform(F.filter(F.zip_with(xs, _sums_before(F.transform(xs, lambda x: x["gap"] + x["size"])), lambda x, b: F.struct(b.alias("before"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value"))), fits), one))

    return F.when(text.rlike(pattern), _let(pieces, placed)).otherwise(empty)


def _apart(spans: Column, base: Column) -> Column:
    """The spans that meet no base span: base spans are looked at by runs that reach that far."""
    runs = _in_runs(base, lambda xs: F.struct(F.array_min(F.transform(xs, lambda x: x["start"])).alias("low"), F.array_max(F.transform(xs, lambda x: x["end"])).alias("high"), xs.alias("spans")))
    meets = lambda s: lambda r: (r["low"] < s["end"]) & (s["start"] < r["high"]) & F.exists(r["spans"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.when(F.size(spans) == 0, spans).otherwise(_let(runs, lambda rs: F.filter(spans, lambda s: ~F.coalesce(F.exists(rs, meets(s)), F.lit(False)))))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, keep: list[str] = ()) -> DataFrame:
    """doc_id, text_hash, the `keep` columns and spans: array of (start, rank, kind, end, n_owners, n_repositories, live), sorted.

    `owner` and `repository` are expressions over `docs`; without them the columns `source` and, within it, `lang`.
    A value is live if at most `max_owners` owners and `max_repositories` repositories hold it. Base kinds are always
    reported, kind `owner` only where the value is live and no base span meets it.
    """
    owner = docs["source"] if owner is None else owner
    repository = F.concat_ws("/", docs["source"], docs["lang"]) if repository is None else repository
    more = [c for c in keep if c != doc_id]
    body = F.coalesce(docs[q(text)], F.lit(""))
    rows = docs.select(docs[q(doc_id)].alias("doc_id"), F.xxhash64(body).alias("text_hash"), packed(docs, more).alias("more") if more else F.lit(0).alias("more"), F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("_repo"), *(_spans(body, k).alias(k) for k in KINDS))
    base = F.concat(*BASE)
    rows = saved(rows.select("doc_id", "text_hash", "more", "_owner", "_repo", F.concat(base, _let(base, lambda b: _apart(F.col("owner"), b))).alias("found")))
    each = rows.where(F.size("found") > 0).select("doc_id", "text_hash", "_owner", "_repo", F.explode("found").alias("span"))
    owned = each.groupBy(F.col("span.hash").alias("hash"), "_owner", "_repo").agg(F.count("*").alias("n")).groupBy("hash", "_owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    counted = table(owned.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n")), "counted")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    spans = table(each.select("doc_id", "text_hash", "span", F.col("span.hash").alias("hash")).distinct(), "candidates")
    judged = join_hot(spans, counted, ["hash"], "n", spans.count()).where(F.col("span.kind").isin(*BASE) | live)
    span = F.struct("span.start", "span.rank", "span.kind", "span.end", "n_owners", "n_repositories", live.alias("live"))
    by_text = judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    by_text = by_text.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    some = rows.where(F.size("found") > 0).join(by_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    nothing = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,n_owners:bigint,n_repositories:bigint,live:boolean>>)")
    columns = ["doc_id", "text_hash", *(fields("more", more) if more else [])]
    return some.select(*columns, F.coalesce("spans", nothing).alias("spans")).unionByName(rows.where(F.size("found") == 0).select(*columns, nothing.alias("spans")))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[REDACTED]", n_chars: str | None = None, **options) -> DataFrame:
    """The documents with each live-looking secret replaced by `mark`; copied examples stay. Spans that overlap are one
    secret. All columns are kept; `n_chars` names a column to set to the new length. The spans go to the texts: Spark
    sends their table to the texts while it is small, by its own size check."""
    found = scan(docs, text, doc_id, **options)
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = table(found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), live.alias("spans")).where(F.size("spans") > 0).distinct(), "live")
    rows = docs.select(packed(docs).alias("row"), docs[q(doc_id)].alias("own_id"), docs[q(text)].alias("body"), F.xxhash64(F.coalesce(docs[q(text)], F.lit(""))).alias("own"))
    joined = rows.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")), "left")

    def pieces(spans: Column) -> Column:
        kept = F.transform(spans, lambda s, i: F.concat(F.substr("body", F.coalesce(F.when(i > 0, F.try_element_at(spans, F.greatest(i, F.lit(1)))["end"]), F.lit(0)) + 1, s["start"] - F.coalesce(F.when(i > 0, F.try_element_at(spans, F.greatest(i, F.lit(1)))["end"]), F.lit(0))), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), F.substr("body", F.element_at(spans, -1)["end"] + 1, F.length("body")))

    none = F.col("spans").isNull()
    out = joined.withColumn("clean", F.when(none, F.col("body")).otherwise(_let(_apart_from_others(F.col("spans")), pieces)))
    new = {text: F.col("clean")}
    if n_chars:
        new[n_chars] = F.when(none, F.col("row").getField(n_chars)).otherwise(F.length("clean").cast(docs.schema[n_chars].dataType))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
