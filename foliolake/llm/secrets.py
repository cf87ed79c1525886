"""Secret scans over an incremental blob ledger.

Every historical version of a path is content-addressed by the SHA-256 of its text.  A ledger holds the
``(blob, rule, version)`` triples that were scanned before together with what was found; only unseen ones are scanned,
rule by rule, each distinct blob once however many paths hold it, and the findings are joined back to all paths.
Everything is DataFrame expressions: a match starts where the pieces of text and the matches before it end.  Those running
sums are taken in runs of ``RUN`` matches, so a text with very many of them costs little more than the search itself.

Findings meet paths by blob and a salt, so that a text that very many paths hold is dealt over tasks; only blobs with
findings are multiplied for it.

Cases: null text counts as empty and has no spans; very long texts are scanned whole; equal rows share a blob; an empty
table gives an empty result; columns other than the path columns and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, new_folder, written


@dataclass(frozen=True)
class Rule:
    """``keeps`` tells from a matched string whether it counts.  Raise ``version`` when either changes: old ledger rows then no longer serve."""

    kind: str
    pattern: str
    keeps: object = None
    version: int = 1


ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The base rules in the order in which kinds are listed.  A run that is long enough starts where a run starts, so the length stands in the pattern; the value of an assignment may hide another one, so its length is tested afterwards.
RULES = (
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
SPAN = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, kind string, version int, found {SPAN}"
#: Matches whose places are summed up together; parts that the paths of one blob are dealt into.
RUN, SALTS = 64, 8
#: Blobs that are told apart by a broadcast at most (about 200 bytes each), and documents and spans of a broadcast redaction.
SPECIAL, LEAKY, LEAKY_SPANS = 100_000, 100_000, 1_000_000


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def runs_of(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, RUN))


def running(values: Column, of_many, of_two) -> Column:
    """The running sums (or greatest) of values: inside runs, and of the runs before."""

    def summed(runs):
        def up_to(of_runs):
            start = lambda k: F.when(k > 0, of_many(F.slice(of_runs, F.lit(1), k))).otherwise(0)
            return F.flatten(F.transform(runs, lambda run, k: let(start(k), lambda before: F.transform(run, lambda _, i: of_two(before, of_many(F.slice(run, F.lit(1), i + 1)))))))

        return let(F.transform(runs, of_many), up_to)

    return let(runs_of(values), summed)


def spans(text: Column, rule: Rule) -> Column:
    """The kept matches of a rule as code-point spans, ends exclusive."""
    pattern, none = F.lit(rule.pattern), F.array().cast(SPAN)

    def placed(matches):
        # The pieces between matches come from the same search.
        steps = F.zip_with(matches, F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)), lambda m, piece: F.length(piece) + F.length(m))
        span = lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"))
        kept = span if rule.keeps is None else lambda m, end: F.when(rule.keeps(m), span(m, end))
        return F.when(F.size(matches) > 0, F.array_compact(F.zip_with(matches, running(steps, total, lambda a, b: a + b), kept))).otherwise(none)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def _named(history: DataFrame, keys: list[str]) -> DataFrame:
    return history.select(*keys, F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def unseen(history: DataFrame, keys: list[str], rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Scans what the ledger lacks: its new rows ``blob, kind, version, found``.

    One row stands for each blob.  Only blobs that several rows hold or that the ledger knows need to be told apart; where
    they are few they are broadcast, so texts are scanned where they lie, and else texts meet them in a join.
    """
    named = _named(history, keys).withColumn("key", F.struct(*keys))
    special = named.groupBy("blob").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    if ledger is not None:
        known = ledger.filter(" OR ".join(f"(kind = '{r.kind}' AND version = {r.version})" for r in rules) or "false")
        special = special.join(known.groupBy("blob").agg(F.collect_set("kind").alias("seen")), "blob", "left").filter("n > 1 OR seen IS NOT NULL")
    else:
        special = special.filter("n > 1").withColumn("seen", F.array().cast("array<string>"))
    special = if_small(written(special.select("blob", "first", "seen"), "special-blobs"), SPECIAL)
    met = named.select("blob", "key", "text").join(special, "blob", "left")
    wanted = F.size(F.array_except(F.array(*[F.lit(r.kind) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))) > 0
    once = met.filter(F.coalesce(F.col("key") == F.col("first"), F.lit(True)) & wanted)
    new = lambda r: ~F.coalesce(F.array_contains("seen", r.kind), F.lit(False))
    found = once.select("blob", *[F.when(new(r), spans(F.col("text"), r)).alias(r.kind) for r in rules])
    # Repeated rows may have left a blob twice; its findings are the same.
    one = found.groupBy("blob").agg(*[F.first(r.kind).alias(r.kind) for r in rules])
    triple = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("found")) for r in rules]
    return one.select("blob", F.explode(F.array(*triple)).alias("r")).select("blob", "r.*").filter("found IS NOT NULL")


def findings(history: DataFrame, keys: list[str], ledger: DataFrame, rules=RULES) -> DataFrame:
    """``keys..., blob`` of all paths with an array of spans per rule, as the ledger has them."""
    held = ledger.filter("size(found) > 0").filter(" OR ".join(f"(kind = '{r.kind}' AND version = {r.version})" for r in rules) or "false")
    by_blob = held.groupBy("blob").agg(*[F.first(F.when(F.col("kind") == r.kind, F.col("found")), ignorenulls=True).alias(r.kind) for r in rules])
    dealt = by_blob.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    paths = _named(history, keys).select(*keys, "blob").withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    return paths.join(dealt, ["blob", "_salt"], "left").select(*keys, "blob", *[F.coalesce(r.kind, F.array().cast(SPAN)).alias(r.kind) for r in rules])


def scan(history: DataFrame, keys: list[str], rules=RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all paths, and the new rows of the ledger.

    ``history``: one row per version of a path, with ``keys`` and ``text``.  Returns ``(keys..., blob, <kind>...)`` with
    an array of spans per rule, and ``(blob, kind, version, found)``; a caller appends the second to its ledger.
    """
    new = written(unseen(history, keys, rules, ledger), "ledger-rows")
    return findings(history, keys, new if ledger is None else ledger.select(*new.columns).unionByName(new), rules), new


class Ledger:
    """A ledger kept as Parquet in a folder that all machines see."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def take(self, delivery: DataFrame, keys: list[str], rules=RULES) -> None:
        """Scans what is new in a delivery and appends it."""
        unseen(delivery, keys, rules, self.rows()).write.mode("append").parquet(self.folder)


def joined(kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then in the order of kinds, joined by commas."""
    def with_kind(nth: int):  # a default argument would be taken for the element's index
        return lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"))

    each = [F.transform(k, with_kind(nth)) for nth, k in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", F.element_at(names, s["nth"] + 1), s["start"], s["end"])), ",")


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    """All documents, delivered in two parts: the second is scanned for what the ledger of the first lacks."""
    kinds, keys = [r.kind for r in RULES], ["doc_id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = Ledger(spark, new_folder(spark, "secrets-ledger"))
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    for delivery in (docs.filter(~second), docs.filter(second)):
        ledger.take(delivery, keys)
    every = joined(kinds)
    return findings(docs, keys, ledger.rows()).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(every, 256).alias("base_sha256"), every.alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by a mark; overlapping spans become one.

    Findings meet rows by ``doc_id`` (null equals null) and text, so rows that share an id may differ in their texts.
    """
    kinds = [r.kind for r in RULES]
    found, _ = scan(docs, ["doc_id"])
    every, text = F.array_sort(F.concat(*[F.col(f"l.{k}") for k in kinds])), F.col("d.text")

    def piece(run):
        """What a run of spans leaves of its part of the text, which is cut out once."""
        base = F.get(run, F.lit(0))["before"]
        part = F.substring(text, base + 1, F.greatest(F.element_at(run, -1)["start"] - base, F.lit(0)))
        left = lambda cut: lambda s: F.when(s["start"] >= s["before"], F.concat(F.substring(cut, s["before"] - base + 1, s["start"] - s["before"]), F.lit(mark))).otherwise("")
        return let(part, lambda cut: F.array_join(F.transform(run, left(cut)), ""))

    def cut_out(spans_):
        def with_ends(reach):
            before = F.concat(F.array(F.lit(0)), reach)
            steps = F.transform(spans_, lambda s, i: F.struct(F.get(before, i).alias("before"), s["start"].alias("start")))
            whole = let(steps, lambda x: F.array_join(F.transform(runs_of(x), piece), ""))
            return F.concat(whole, F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

        return let(running(F.transform(spans_, lambda s: s["end"]), F.array_max, F.greatest), with_ends)

    merged = let(every, cut_out)
    leaky = found.filter(" OR ".join(f"size({k}) > 0" for k in kinds)).dropDuplicates(["doc_id", "blob"]).select("doc_id", "blob", *kinds)
    leaky = written(leaky, "leaky")
    if (leaky.agg(F.sum(sum((F.size(k) for k in kinds), F.lit(0)))).first()[0] or 0) <= LEAKY_SPANS:
        leaky = if_small(leaky, LEAKY)
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("l.blob"))
    clean = F.when(F.col("l.blob").isNull(), text).otherwise(merged)
    out = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return docs.alias("d").join(leaky.alias("l"), same, "left").select(*[out.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def _oracle() -> str:
    """Matches and the pieces between them give each match its start."""
    assign = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [("assign", assign, f"length(regexp_extract(m, '{assign}', 1)) >= 6"), ("access", "AKIA[A-Z0-9]{16,}", "true"), ("hex", "[0-9a-f]{24,}", "true")]
    parts = []
    for nth, (kind, pattern, keep) in enumerate(kinds):
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {nth} AS nth, m, s, {keep} AS keep FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: "
            f"list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0)))::BIGINT AS s "
            f"FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d) WHERE len(ms) > 0)"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE keep), "
        "g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        "string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, nth) AS spans FROM f GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
        "sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"
    )


ORACLE = _oracle()
