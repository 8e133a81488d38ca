"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

A text's candidate spans come from patterns (the three base kinds and some formats of
well-known issuers; a private key's span runs to its END line, and its body is what is
counted). Spark gives matched strings but no places, so places are rebuilt:
``split`` gives the text between the matches of a pattern, and running lengths of both
are the places. Candidate values are then hashed and counted over the whole corpus by
distinct repositories and owners: a value that many owners hold is a widely copied
example; one that few hold, and that is no placeholder, looks live.

Places are code points, ends exclusive. Defined results: a null text is an empty one
with no span; a null source counts as one unnamed repository; rows are judged one by one,
so repeated rows give repeated results; an empty table gives none. The same value in many
rows of one owner still counts as one owner. A key block without a body is never live. Very
long texts are scanned whole. Input columns named like new ones are replaced; ``redact``
leaves all other columns, whatever their names, as they are. The query's ``ownership`` has
owners/repositories of every span's value, in the order of ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import materialize
from statloom.llm.components import told

#: Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so this is every run of 24 or more
KINDS = ("assign", "access", "hex")
#: What the method adds: kind, pattern, and a string that every match holds.
ADDED = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:GAP(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:GAP[A-Za-z0-9+/=]{16,}+)*+(?:GAP(?:[A-Za-z0-9+/=]{1,76}GAP)?-----END [A-Z ]*PRIVATE KEY-----)?".replace("GAP", r"(?:\s|\\[nr])*+"), "PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "_"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    ("google", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
)
PLACEHOLDER = r"(?i)(example|changeme|placeholder|dummy|sample|your|xxxx|0{8}|1234567)"
_NONE = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, least: int) -> Column:
    """Spans of all matches of ``pattern`` with ``least`` characters or more."""

    def place(matches: Column) -> Column:
        def grown(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["piece"])
            end = start + F.length(pair["match"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["match"].alias("value")))).alias("out"))

        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        begin = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), _NONE).alias("out"))
        pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
        return F.when(F.size(matches) > 0, F.aggregate(pairs, begin, grown, lambda s: s["out"])).otherwise(F.from_json(F.lit("[]"), _NONE))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    return F.filter(found, lambda s: F.length(s["value"]) >= least) if least else found


def candidate_spans(text: Column) -> Column:
    """All spans of a text by start, then kind: array of (start, kind, end, value)."""
    none = F.from_json(F.lit("[]"), _NONE)
    assign = F.filter(
        F.transform(
            F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), _spans(text, ASSIGN, 0, 0)).otherwise(none),
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.regexp_extract(s["value"], ASSIGN, 2).alias("value")),
        ),
        lambda s: F.length(s["value"]) >= 6,
    )
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, 20)).otherwise(none)
    parts = [assign, access, _spans(text, HEX, 2, 24)]
    for k, (_, pattern, must) in enumerate(ADDED, len(KINDS)):
        parts.append(F.when(F.contains(text, F.lit(must)), _spans(text, pattern, k, 0)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *(a[0] for a in ADDED))])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_of(value: Column) -> Column:
    """What a span keeps secret: the body of a key block, else the value itself."""
    body = F.regexp_replace(value, r"-----[A-Z ]+-----|\\[nr]|\s|(?:Proc-Type|DEK-Info):[^\n]*", "")
    return F.when(F.startswith(value, F.lit("-----BEGIN")), body).otherwise(value)


def ownership(candidates: DataFrame, source_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """Distinct repositories and owners by hash of a candidate's secret, over the corpus.

    ``candidates`` has ``spans`` and the source of each row; the owner is ``owner_col``,
    or else the source's part before a slash (without a slash, owner and repository are
    one). Repeats fall away before the shuffle, so one value that a third of all rows hold
    moves as one row a task and source."""
    source = F.coalesce(F.col(source_col), F.lit(""))
    owner = F.coalesce(F.col(owner_col), F.lit("")) if owner_col else F.substring_index(source, "/", 1)
    each = candidates.select(source.alias("repository"), owner.alias("owner"), F.explode("spans").alias("s")).select("repository", "owner", F.sha2(secret_of(F.col("s.value")), 256).alias("hash"))
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    return by_owner.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"), F.sum("places").alias("n"))


def judge(marked: DataFrame, source_col: str = "source", owner_col: str | None = None, example_owners: int = 3) -> DataFrame:
    """``marked`` (with ``spans``) and ``values``: value, owners, repositories and live of
    each distinct value of a row."""
    none = F.expr("cast(array() as array<struct<value:string,owners:bigint,repositories:bigint,live:boolean>>)")
    names = [f"`{c}`" for c in marked.columns]
    clean = marked.filter(F.size("spans") == 0).withColumn("values", none)
    # only rows with a candidate need the corpus; their number and place are fixed here
    held = materialize(marked.filter(F.size("spans") > 0).withColumn("__key", F.monotonically_increasing_id()), "secrets")
    counts = ownership(held, source_col, owner_col)
    each = held.select("__key", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value"))
    each = materialize(each.withColumn("hash", F.sha2(secret_of(F.col("value")), 256)), "candidates")
    secret = secret_of(F.col("value"))
    live = (F.col("owners") < example_owners) & (F.length(secret) > 0) & ~secret.rlike(PLACEHOLDER)
    # a value of very many rows is told to all tasks, its rows are no group of a join
    judged = told(each, counts, "hash", each.count()).select("__key", F.struct("value", "owners", "repositories", live.alias("live")).alias("v"))
    judged = judged.groupBy("__key").agg(F.sort_array(F.collect_list("v")).alias("values"))
    return clean.unionByName(held.join(judged, "__key", "left").select(*names, F.coalesce("values", none).alias("values")))


def scan(docs: DataFrame, text_col: str = "text", source_col: str = "source", owner_col: str | None = None, example_owners: int = 3) -> DataFrame:
    """``docs`` with ``spans``, ``values`` and ``live``: all spans; the distinct values with
    their owners and repositories; and those that few owners hold (fewer than
    ``example_owners``) and that are no placeholders. Columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("spans", "values", "live")]
    marked = docs.select(*[f"`{c}`" for c in names]).withColumn("spans", candidate_spans(F.coalesce(F.col(text_col), F.lit(""))))
    return _with_live(judge(marked, source_col, owner_col, example_owners))


def _with_live(judged: DataFrame) -> DataFrame:
    return judged.withColumn("live", F.transform(F.filter("values", lambda v: v["live"]), lambda v: v["value"]))


def secrets_query(docs: DataFrame) -> DataFrame:
    # the patterns run once: what they find is written without the texts
    marked = docs.select("doc_id", "source", candidate_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    found = _with_live(judge(materialize(marked, "spans")))
    held = lambda s: F.get(F.filter("values", lambda v: v["value"] == s["value"]), F.lit(0))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: F.array_contains("live", s["value"]))).cast("long").alias("n_live"),
        F.array_join(F.transform("spans", lambda s: _let(held(s), lambda v: F.concat_ws("/", v["owners"].cast("string"), v["repositories"].cast("string")))), ",").alias("ownership"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with live-looking values replaced by a mark; copied examples and all other
    text stay. ``n_chars`` follows the text."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")  # any names it may have
    found = scan(docs.select(row, F.col("text"), F.col("source")))
    longest = F.array_sort("live", lambda a, b: F.length(b) - F.length(a))
    text = F.when(F.size("live") > 0, F.aggregate(longest, F.col("text"), lambda t, v: F.replace(t, v, F.lit("[secret]")))).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.size("live") > 0, F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("__row.n_chars") if "n_chars" in names else F.lit(None))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`") for c in names])
